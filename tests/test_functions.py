import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import answers, numbers, text
from tidewright.plans import scoring


def one(spark, value, *columns, schema="v string"):
    df = spark.createDataFrame([(v,) for v in value], schema)
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    return [tuple(r) for r in rows] if len(columns) > 1 else [r[0] for r in rows]


V = None


@pytest.fixture(autouse=True, scope="module")
def _column(spark):
    global V
    V = F.col("v")


def test_text_cleaning(spark):
    values = ["  Ab\nC ", None, "", " \t", "x" * 50]
    assert one(spark, values, text.normalized_text(V)) == ["abc", "", "", "", "x" * 50]
    assert one(spark, values, text.short_text(V, 5)) == ["Ab C", "unknown", "unknown", "unknown", "xxxxx"]
    assert one(spark, values, text.ellipsis_text(V, 5)) == ["Ab C", "", "", "", "xxxx…"]
    assert one(spark, ["a b-c!", "__x"], text.safe_id(V)) == ["a_b_c", "x"]
    assert one(spark, [["b", "unknown", " ", "b", "a"]], text.short_list(V, 3), schema="v array<string>") == [["b", "a"]]
    assert one(spark, [[" b  b", "b b", "", None, "a"]], text.unique_texts(V), schema="v array<string>") == [["b b", "a"]]


def test_ladders(spark):
    assert one(spark, ["我是警长", "在大厅", "他杀了人", "我没动", "我看见他", "hm"], text.infer_claim_type(V)) == ["role", "location", "accusation", "defense", "sighting", "other"]
    assert one(spark, ["x"], text.infer_strategic_role(F.lit("sighting"), V), text.infer_strategic_role(F.lit("other"), F.lit("投他"))) == [("information_sharing", "accusation")]
    assert one(spark, ["not-enough info", "True", None, "maybe"], text.normalize_enum(V)) == ["not_enough_information", "supported", None, "maybe"]
    roster = F.array(F.lit("ana"), F.lit("bo"))
    assert one(spark, ["bo met ana", None], text.mentioned(V, roster)) == [["ana", "bo"], []]
    assert one(spark, ["a1", "bo", "zed"], text.normalize_player(V, roster, {"a1": "ana"}, "bo")) == ["ana", "bo", "bo"]
    assert one(spark, [["a1", "x", "ana"]], text.normalize_players(V, roster, {"a1": "ana"}), schema="v array<string>") == [["ana"]]
    assert one(spark, ["bo 在投票，选择了“ana”。", "bo 在投票"], text.vote_of(V, roster)) == [("bo", "ana"), (None, None)]
    assert one(spark, ["不是我", "投他", "hm"], text.reaction_action(F.lit(None).cast("string"), V)) == ["defend", "accuse", "respond"]


def test_overclaim_denials_lie_wholly_within_eight_characters(spark):
    values = ["dead body; cannot xxxx killer", "dead body, not confirm killer", "dead body cannot killer", "body 无法确认杀手", "dead 不能说是凶手", "dead cannot  killer"]
    assert one(spark, values, text.death_overclaim(V)) == [True, True, False, False, False, False]


def test_overclaims(spark):
    values = ["尸体旁的凶手是他", "有尸体，无法确认凶手", "凶手", "dead body, the Killer", "body; cannot name role", None]
    assert one(spark, values, text.death_overclaim(V)) == [True, False, False, True, True, False]  # "cannot" begins twelve characters before "role"
    forbidden = F.array(F.lit("e9"))
    assert one(spark, ['{"a": "e9"}', "{}"], text.oracle_overclaim(V, F.lit("I clearly saw"), F.array().cast("array<string>"), F.lit(None).cast("boolean")), text.oracle_overclaim(V, F.lit(""), forbidden, F.lit(None).cast("boolean")), text.oracle_overclaim(V, F.lit(""), F.array().cast("array<string>"), F.lit(False))) == [(False, True, True), (False, False, True)]


@pytest.mark.parametrize("raw,want", [
    ("B", "B"), ("(c)", "C"), ("Answer: b", "B"), ("<think>answer is A</think> so D", "D"), ("user\nA?\nassistant:\nanswer: C\nuser\nB", "C"), ("<|im_start|>assistant\nThe choice B<|im_end|> D", "B"),
    ("x\nAnswer is A", "A"), ("", ""), ("nothing", ""), ("A. since", "A"), ("either A or else D", "D"), ("E", ""),
])
def test_choices(spark, raw, want):
    assert one(spark, [raw], text.extract_choice(V)) == [want]


def test_evidence_gates(spark):
    start = "游戏模式：经典版 工程师"
    assert one(spark, [start, start + " 任务列表", "工程师", start + " 投票界面", "游戏模式 自定义 跳过投票"], text.accepts_start(V, ["工程师"])) == [True, False, False, False, True]
    assert one(spark, ["鹅鸭胜利", "胜利", "准备房 鹅胜利", "x", "鹅失败了"], text.accepts_end(V)) == [True, False, False, False, False]
    assert one(spark, ["鹅鹏 胜利", "x", None], text.result_label(V, F.lit("defeat"))) == ["鹈鹕胜利", "失败", "失败"]
    assert one(spark, ["¿que?", "mulher", "когда", "Sollte er", "est-ce", "bør", "hm"], text.language_of(F.lit(None).cast("string"), V)) == ["西班牙语", "葡萄牙语", "俄语", "德语", "法语", "丹麦语", "未知"]
    assert one(spark, ["El hombre DEBERÍA hablar", "BØR han", "ЁЖ", "SOLL er", None], text.language_of(F.lit(" "), V)) == ["西班牙语", "丹麦语", "俄语", "德语", "未知"]
    assert one(spark, ["A. Ana said hi there", "B) nobody"], text.speaker_content(V, ["said", "asked"])) == [("ana", "said hi there", True), ("", "nobody", False)]
    assert one(spark, ["x\nB\n\n", "b is it"], text.last_line_letter(V)) == ["B", "b is it"]


def test_means_round_halves_alike_in_any_order(spark):
    mean = lambda rows, digits: spark.createDataFrame([(float(r),) if r is not None else (None,) for r in rows], "v double").agg(numbers.exact_mean(F.col("v"), digits)).first()[0]
    assert mean([0.000001, 0.000002], 6) == 0.000002
    assert mean([0.1, 0.2, None], 1) == 0.2 and mean([-0.1, -0.2], 1) == -0.1
    assert mean([None], 6) is None
    values = [0.3, 0.000001, 0.7, 0.1, 0.2, 0.6, 0.4, 0.5] * 40
    assert len({mean(sorted(values, key=lambda v: (v * k) % 1), 6) for k in range(1, 6)}) == 1


def test_numbers(spark):
    assert one(spark, ["high", "低", "2", "-1", "0.3", "?", None, "true"], numbers.certainty(V)) == [0.85, 0.35, 1.0, 0.0, 0.3, 0.5, 0.5, 1.0]
    assert one(spark, ["00:17:00", "1:05", "12", "", "x", "a:b"], numbers.protocol_seconds(V)) == [17.0, 65.0, 12.0, 0.0, 0.0, 0.0]
    assert one(spark, ["about 60", "12.5", "999", "-5", "?"], numbers.nearest_bucket(V)) == [50, 0, 100, 0, 0]
    iou = numbers.interval_iou(F.lit(0.0), F.lit(10.0), V, V + 10)
    assert one(spark, [0.0, 5.0, 20.0], iou, schema="v double") == [1.0, pytest.approx(1 / 3), 0.0]
    assert one(spark, [1.0], numbers.clip_window(V, V, F.lit(0.0), F.lit(10.0)), numbers.clip_window(F.lit(50.0), F.lit(60.0), F.lit(0.0), F.lit(10.0)), schema="v double") == [((1.0, 2.0), (0.0, 10.0))]
    assert one(spark, [8.0], numbers.context_window(V, F.lit(20.0), 10.0, 2.0, 15.0), schema="v double") == [(7.0, 22.0)]
    assert one(spark, [61.0, 3661.0], numbers.clock_text(V), schema="v double") == ["00:01:01", "01:01:01"]
    assert one(spark, ["Yes", "0", "?"], numbers.parse_bool(V, True)) == [True, False, True]


def test_json_answers(spark):
    raws = ['{"a": 1}', 'so {"a": {"b": 2}} ok', "[1, 2]", "nope", "", None, '{"a": 1} and {"b": 2}']
    got = one(spark, raws, answers.parse_answer(V)["parse_ok"], F.to_json(answers.parse_answer(V)["parsed"]))
    assert [g[0] for g in got] == [True, True, False, False, False, False, False]
    assert json.loads(got[1][1]) == {"a": {"b": 2}}
    assert one(spark, ["[1, 2]"], answers.parse_answer(V, objects_only=False)["parse_ok"]) == [True]
    assert one(spark, ["x ```json\n{}\n``` y", "```\n[1]", "{}"], answers.strip_fences(V)) == ["{}", "[1]", "{}"]
    assert one(spark, ['{"a": null, "b": 1}'], answers.first_present(V, ["a", "b"]), answers.first_present(V, ["c", "b"]), answers.first_present(V, ["z"])) == [(None, "1", None)]
    assert one(spark, ['{"a": 1, "b": 2}', "{}", "x"], answers.schema_matches(V, F.array(F.lit("a")))) == [True, False, False]
    assert one(spark, ['{"x": {"evidence_ids": ["e1", 3], "event_id": "w2"}, "y": [{"claim_id": "c"}], "z_ids": "no"}'], answers.cited_ids(V), answers.evidence_ids(V)) == [(["c", "e1", "w2"], ["3", "e1"])]
    assert one(spark, ['{"a": {"k": "v", "secret": 1}, "secret": [2]}'], answers.without_keys(V, ["secret"]), answers.has_key_value(V, "k", "v"), answers.has_key_value(V, "k", "w")) == [('{"a": {"k": "v"}}', True, False)]
    assert one(spark, ['{"knows_truth": false, "belief_label": "x"}', '{"knows_truth": false}'], answers.schema_ok(F.lit("A"), V), answers.schema_ok(F.lit("Z"), V)) == [(True, True), (False, True)]


def test_json_recovery(spark):
    cut = '[{"a": 1}, {"b": "}{"}, {"c":'
    got = one(spark, [cut, "[]", None, '{"a"'], answers.recover_array(V), answers.recover_objects(V), answers.recover_object(V))
    assert [json.loads(x) for x in got[0][0]] == [{"a": 1}, {"b": "}{"}]
    assert [json.loads(x) for x in got[0][1]] == [{"a": 1, "needs_human_review": True, "certainty": 0.5}, {"b": "}{", "needs_human_review": True, "certainty": 0.5}]
    assert json.loads(got[0][2])["a"] == 1
    assert got[1:] == [(None, [], None)] * 3
    assert len(one(spark, ["[" + ",".join('{"certainty": 0.2}' for _ in range(9)) + "]"], answers.recover_objects(V))[0]) == 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), st.text(st.sampled_from(list('{}[]"\\ab,')), max_size=6), max_size=3), max_size=5), st.integers(0, 60))
def test_partial_objects_find_whole_ones(items, cut):
    whole = json.dumps(items)
    found = [json.loads(x) for x in answers.partial_objects(whole[: max(0, len(whole) - cut)], most=99)]
    for got, want in zip(found, items):
        assert {k: v for k, v in got.items() if k not in ("needs_human_review", "certainty")} == {k: v for k, v in want.items() if k not in ("needs_human_review", "certainty")}
    if cut == 0:
        assert len(found) == len(items)


def test_stable_hash_and_split(spark):
    a, b = one(spark, ['{"b": 1, "a": "é"}', '{"a":"é","b":1}'], answers.stable_hash(V))
    assert a == b
    import hashlib

    ids = [f"g{i}" for i in range(50)]
    want = [("train", "dev", "test")[0 if v < 7 else 1 if v < 9 else 2] for v in (int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % 10 for i in ids)]
    assert one(spark, ids, answers.split_of(V)) == want


def test_tri_state_rates(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    row = df.agg(scoring.rate(V).alias("a"), scoring.mean_of(V).alias("b")).first()
    assert row.a == pytest.approx(1 / 3) and row.b == 0.5
    assert df.limit(0).agg(scoring.rate(V).alias("a"), scoring.mean_of(V).alias("b")).first() == (0.0, None)


def test_mcnemar_and_gates(spark):
    a = spark.createDataFrame([(i, i < 8) for i in range(10)], "id int, ok boolean")
    b = spark.createDataFrame([(i, i >= 5) for i in range(10)], "id int, ok boolean")
    r = scoring.mcnemar(a, b, "id", "ok").first()
    assert (r.a_only, r.b_only) == (5, 2) and r.statistic == pytest.approx(4 / 7) and r.p_value == pytest.approx(math.erfc(math.sqrt(4 / 14)))
    same = scoring.mcnemar(a, a, "id", "ok").first()
    assert (same.statistic, same.p_value) == (0.0, 1.0)
    rows = spark.createDataFrame([(True, "A", 50), (True, "B", 50), (False, "A", 50)], "ok boolean, a string, s int")
    assert [r[0] for r in rows.select(scoring.gated_score(F.col("ok"), F.col("a"), F.col("s"))).collect()] == [50, None, 0]


def test_leading_objects():
    cases = {
        '[{"a": 1}, {"b": 2}, {"c":': ['{"a": 1}', '{"b": 2}'],
        '[1, {"a": 1}, [{"x": 1}], {"b": "}]"}]': ['{"a": 1}', '{"b": "}]"}'],
        '[{"a":1},,{"b":2}]': ['{"a": 1}', '{"b": 2}'],
        '[{"a":1} junk {"b":2}]': ['{"a": 1}'],
        '[{"a":1}, {bad}, {"b":2}]': ['{"a": 1}'],
        '{"a":1}': [],
    }
    assert {t: answers.leading_objects(t) for t in cases} == cases
