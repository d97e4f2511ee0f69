"""Queries that hold scalars, small aggregates and checks against DuckDB twins over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import answers, numbers, text
from tidewright.operators import aggregates, joins, selection, windows
from tidewright.plans import checks, ledger, review, trajectory
from tidewright.plans.event_queries import EV, GAMES, games, roster

PLAYERS = ("baile", "saoyi", "Gemini")


def _k() -> Column:
    return F.col("k")


def _pick(*values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (_k() % len(values) + 1).cast("int"))


def _names() -> Column:
    return F.array(*[F.lit(p) for p in PLAYERS])


def claim_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders, keys and cues of claim texts."""
    said = _pick("他在大厅杀人", "我没投票", "看到 baile", "hello", "身份 警长", "saoyi 骗 你")
    kind = text.infer_claim_type(said)
    ck, ek = text.claim_key(_pick("baile", None), kind, said), text.event_key(_pick("kill", None), F.when(_k() % 2 == 0, F.array(F.lit("b"), F.lit("a"))), _pick("hall", None, "room"))
    return games(spark, sf_dir).select(
        "event_id", kind.alias("claim_type"), text.infer_strategic_role(kind, said).alias("strategic_role"), F.array_join(text.mentioned(said, _names()), ",").alias("mentioned"), text.cue_score(said).cast("bigint").alias("cues"), text.reaction_action(kind, said).alias("action"),
        ck["speaker"].alias("key_speaker"), ck["text"].alias("key_text"), ek["event_type"].alias("event_type"), ek["actor"].alias("actor"), ek["location"].alias("location"), text.normalize_player(_pick("末将", "baile", "", None), _names(), {"末将": "saoyi"}, "unknown").alias("player"), F.array_join(text.short_list(F.array(said, F.lit("x"), said), 3, 4), ",").alias("short"),
    )


def vote_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick("baile 在投票，选择了 “saoyi”。", "saoyi 在投票 选择了 。", "投票 选择了 Gemini", "Gemini 在投票")
    v = text.vote_of(said, _names())
    evidence = _pick("游戏模式: 经典版 获胜", "鹅鹕 胜利", "失败", "准备房 游戏模式：自定义", "游戏模式 经典版 投票界面 获胜", "鸭子阵营 失败!")
    return games(spark, sf_dir).select("event_id", v["voter"].alias("voter"), v["target"].alias("target"), text.boundary_ok(_pick("game_start", "game_end", "odd"), evidence, ["警长"]).alias("ok"), text.result_label(evidence, _pick("defeat", "victory", None)).alias("result"), text.language_of(_pick("", "note", None), _pick("¿debe hablar?", "Wer soll sprechen", "hello", "est-ce", "скажи")).alias("language"))


def overclaims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Death words with causes: a denial counts if it lies wholly within the eight characters before the cause."""
    said = _pick("dead body; cannot xxxx killer", "dead body, not confirm killer", "dead cannot killer", "body 无法确认杀手", "尸体 凶手", "killer alone", "dead alone", "BODY; it cannot be killer")
    forbidden = F.when(_k() % 2 == 0, F.array(F.lit("ge_9"))).otherwise(F.array().cast("array<string>"))
    raw = _pick("I clearly saw", "saw ge_9", "nothing")
    return games(spark, sf_dir).select("event_id", text.death_overclaim(said).alias("death"), text.oracle_overclaim(F.lit("{}"), raw, forbidden, F.when(_k() % 5 == 0, F.lit(False))).alias("oracle"))


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick("thinking\nB", "a long line\nno letter", "Yes, it is", "不 是的", "no", "answer A")
    option = _pick("A. Baile says go home", "b) Saoyi asked 'why'", "just this")
    sc = text.speaker_content(option, ["says", "asked"])
    return games(spark, sf_dir).select(
        "event_id", text.last_line_letter(said).alias("letter"), text.yes_no_choice(said).alias("yes_no"), text.number_after(F.concat(F.lit("score: "), _pick("7.5", "x")), r"score:\s*(-?\d+(?:\.\d+)?)", 1.0).alias("number"), text.phase_of(_pick("g_meeting_1", "x_final", "none"), _pick("", "given", None)).alias("phase"), text.leaked([F.concat(F.lit("says "), _pick("the hidden text here", "nothing"))], F.lit("the hidden text here")).alias("leaked"),
        F.array_join(text.red_flags(F.concat(F.lit("An "), _pick("ORACLE", "x")), ["oracle", "an", "gold"]), ",").alias("flags"), sc["speaker"].alias("speaker"), sc["content"].alias("content"), sc["split"].alias("split"), text.normalized_description(_pick("看到了 Baile 的尸体。", "在街道上 X")).alias("description"),
    )


def number_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("s"), F.col("e")
    w, raw, c, cs = numbers.clip_window(s - 5 + _k() % 3 * 100, e - 90 + _k() % 3 * 100, s, e), numbers.raw_interval(F.lit(1.5), F.lit(-40.0), s, e, F.lit(2_000_000.0)), numbers.context_window(s, e, 8.0, 8.0, 60.0), windows.clip_span(s + _k() % 9, 3.0, 4.0, s, e)
    return games(spark, sf_dir).select(
        "event_id", numbers.local_window_ok(_k() - 1.0, _k() + 5.0, F.lit(60.0)).alias("local_ok"), w["start_sec"].alias("clip_start"), w["end_sec"].alias("clip_end"), raw["raw_start"].alias("raw_start"), raw["ok"].alias("raw_ok"), c["start_sec"].alias("context_start"), c["end_sec"].alias("context_end"), cs["start_sec"].alias("span_start"), cs["end_sec"].alias("span_end"),
        numbers.clock_text(s).alias("clock"), numbers.clamp_or(_pick("0.4", "x", "9"), 0.25).alias("clamped"), numbers.parse_bool(_pick("Yes", "0", "odd", None), True).alias("flag"), numbers.interval_iou(s, e, s + 20, e + 20).alias("iou"), numbers.to_absolute(s, _k()).alias("absolute"),
    )


def array_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top items, tails, options, preferences and evidence differences of arrays."""
    item = F.array(*[F.struct(((_k() * i + 3) % 7).cast("double").alias("certainty"), ((_k() + i) % 2).alias("review"), F.lit(f"i{i}").alias("id")) for i in range(1, 5)])
    ids = lambda xs: F.array_join(F.transform(xs, lambda x: x["id"]), ",")
    opts = selection.options_without_repeats(F.array(F.lit("x"), _pick("x", "y"), F.lit("z")), F.lit("z"))
    return games(spark, sf_dir).select(
        "event_id", ids(selection.top_items(item, ["certainty", "review"], 2)).alias("by_certainty"), ids(selection.top_items(item, ["review", "certainty"], 2)).alias("by_review"), ids(windows.tail(item, 2)).alias("tail"), F.array_join(opts["options"], ",").alias("options"), opts["letter"].alias("letter"),
        selection.prefer(F.array(F.lit("c"), _pick("a", "b")), F.array(F.lit("b"), F.lit("c"))).alias("preferred"), F.array_join(trajectory.subject_only(F.array(F.lit("e2"), F.lit("e1"), F.lit("e2")), F.array(_pick("e1", "e9"))), ",").alias("subject_only"), ledger.other_player(F.array(_pick("t", "a")), F.lit("t"), F.array(F.lit("t"), F.lit("z"))).alias("other"), F.array_join(text.unique_texts(F.array(F.lit(" a  b"), F.lit("a b"), _pick("", "c"))), "|").alias("unique"),
    )


def answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks, checks and hashes of answers' JSON."""
    j = F.concat(F.lit('{"evidence_ids": ["a", "b'), _k(), F.lit('"], "x": {"event_id": "ev'), _k() % 3, F.lit('", "claim_ids": ["c"]}, "y": null}'))
    snap = F.struct(F.array(*[F.lit(f"p{i}") for i in range(4)]).alias("public_history"), F.array(F.lit("h")).alias("heard_claims"))
    return games(spark, sf_dir).select(
        "event_id", F.array_join(answers.cited_ids(j), ",").alias("cited"), F.array_join(answers.evidence_ids(j), ",").alias("evidence"), answers.first_present(j, ["none", "y", "x"]).alias("first"), answers.schema_matches(j, F.array(F.lit("x"), _pick("y", "q"))).alias("matches"), answers.cites_forbidden(j, F.array(_pick("ev1", "", "zz"))).alias("forbidden"), answers.has_key_value(j, "event_id", "ev1").alias("has_value"),
        F.get_json_object(answers.without_keys(j, ["x"]), "$.x").isNull().alias("stripped"), answers.compact_context(snap, {"public_history": 2, "heard_claims": 5}).alias("context"), answers.stable_hash(F.concat(F.lit('{"b": 1, "a": '), _k(), F.lit("}"))).alias("hash"), answers.task_key(_pick("t", "u"), F.lit("m")).alias("task_key"),
    )


def _events(ev: DataFrame) -> DataFrame:
    return ev.select(
        "event_id", "k", _pick("gameplay", "meeting", "gameplay").alias("phase_type"), _pick("kill", "vote", "encounter", "unknown").alias("event_type"), _pick("a plain thing", "voting now", "尸体 here").alias("description"), (_k() % 10 / 10).alias("certainty"), (_k() % 6 == 0).alias("needs_human_review"), F.array(_pick("baile", "odd")).alias("source_povs"),
        F.array(_pick("g_final_000010_x", "g_gameplay_000010_x")).alias("source_segment_ids"), (F.lit(10.0) + _k() % 30).alias("abs_start_sec"), (F.lit(10.0) + _k() % 30 + _k() % 20).alias("abs_end_sec"), _pick("qwen_seed", None).alias("gold_source"), _pick("baile", "who").alias("speaker"), _pick("location", "odd", "defense").alias("claim_type"), _pick("没用的话很多很多", "a claim of length", "short").alias("content"),
    )


def event_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(games(spark, sf_dir))
    rank = ledger.gold_rank(F.col("event_type"), F.col("description"), F.col("claim_type"), F.col("certainty"), F.col("certainty"), _pick("contradicted", "supported", "ambiguous", None), ["kill"])
    return rows.select("event_id", ledger.is_clean_event(_names()).alias("clean"), ledger.is_usable_claim(_names()).alias("usable"), ledger.diagnostic_event_allowed().alias("allowed"), rank.cast("bigint").alias("gold_rank"))


def review_reason_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(games(spark, sf_dir))
    event = F.struct("phase_type", "event_type", "description", "certainty", "needs_human_review", "source_povs", "source_segment_ids", "abs_start_sec", "abs_end_sec")
    rows = rows.select("event_id", event.alias("event"), _pick("hidden_event_awareness", "contradicted_alibi", "other").alias("template"), _pick("baile", "saoyi").alias("target"), (F.col("abs_start_sec") + _k() % 5 - 2).alias("cutoff"), (_k() % 4 == 0).alias("needs_human_review"), _pick("location", "role_claim", "x").alias("ct"), _pick("accuse", "coordinate_vote", "other").alias("fn"))
    return rows.select("event_id", F.array_join(review.probe_metadata_reasons(), ",").alias("metadata"), F.array_join(review.probe_uses(F.col("ct"), F.col("fn")), ",").alias("uses"))


def checker_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row checks of evidence, claims, rosters, times and segments, counted."""
    ev = games(spark, sf_dir)
    rows = ev.select(
        F.format_string("r%08d", "event_id").alias("id"), _pick("e", " ", None).alias("visual"), _pick("", "a").alias("audio"), (_k() % 3 == 0).alias("is_claim"), (_k() % 2 == 0).alias("is_fact"), F.array(_pick("baile", "odd", "saoyi")).alias("source_povs"), F.concat(F.lit("text ge_"), _k() % 4).alias("body"), F.array(F.lit("ge_2"), F.lit("")).alias("hidden"), F.lit(5.0).alias("local_start_sec"), (F.lit(5.0) + _k() % 4).alias("local_end_sec"),
        F.col("s").alias("aligned_start_sec"), F.col("e").alias("aligned_end_sec"), (F.col("s") + 5 + F.when(_k() % 7 == 0, 1).otherwise(0)).alias("abs_start_sec"), (F.col("s") + 5 + _k() % 4).alias("abs_end_sec"), (_k() % 12 / 10).alias("certainty"), (F.col("e") - F.col("s") + F.when(_k() % 5 == 0, 1).otherwise(0)).alias("duration_sec"), (_k() % 3).cast("int").alias("pov_count"),
    )
    view = lambda p: F.struct(p.alias("player_id"), F.col("aligned_start_sec"), (F.col("aligned_end_sec") + F.when(F.col("pov_count") == 2, 1).otherwise(0)).alias("aligned_end_sec"))
    segs = rows.withColumnRenamed("id", "segment_id").withColumn("povs", F.when(F.col("is_fact"), F.array(view(F.lit("baile")), view(F.lit("baile")))).otherwise(F.array(*[view(F.lit(p)) for p in PLAYERS])))
    parts = [checks.evidence_checker(rows, "id", ["visual", "audio"]), checks.claim_fact_checker(rows, "id"), checks.roster_checker(rows, "id", _names()), checks.leakage_checker(rows, "id", "body", "hidden"), checks.timed_evidence(rows, "id"), checks.time_formula(rows, "id"), checks.segments(segs, _names())]
    return checks.report(parts).groupBy("check", "code").agg(F.count("*").alias("n_issues"), F.min("key").alias("first_key"))


def small_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player states, language reports, repeated keys, first values and segment members, by game."""
    ev = games(spark, sf_dir)
    states = aggregates.player_states(ev.withColumn("d", F.col("event_id").cast("string")).withColumn("conf", F.floor("value") / 64), ["game_id", "user_id"], "e", "d", "conf")
    a = states.select("game_id", F.lit("state").alias("kind"), F.col("user_id").alias("key"), F.size("known_facts").cast("double").alias("x"), F.round("confidence", 6).alias("y"))
    lang = aggregates.by_language(ev.withColumn("ok", _k() % 2 == 0).withColumn("q2", (_k() % 5).cast("double")), _pick("de", "en"), "ok", "q2")
    b = lang.select(F.lit(-1).cast("bigint").alias("game_id"), F.concat(F.lit("language "), "language").alias("kind"), F.col("n").alias("key"), F.col("n_correct").cast("double").alias("x"), F.round("second_mean", 6).alias("y"))
    c = selection.duplicates(ev.withColumn("p", F.concat_ws("|", "game_id", "k")), "p").groupBy().agg(F.count("*").alias("n"), F.max("n").alias("m")).select(F.lit(-1).cast("bigint").alias("game_id"), F.lit("duplicates").alias("kind"), F.col("n").alias("key"), F.col("m").cast("double").alias("x"), F.lit(0.0).alias("y"))
    d = aggregates.first_where(ev, ["game_id"], "event_id", _k() > 50, "k").select("game_id", F.lit("first").alias("kind"), F.col("k").alias("key"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    e = aggregates.segment_assembly(ev.select("game_id", (_k() % 4).alias("w"), F.col("event_id").alias("m"), "k"), ["game_id", "w"], "m", ["k"]).select("game_id", F.lit("segment").alias("kind"), F.col("w").alias("key"), F.col("member_count").cast("double").alias("x"), F.get("members", 0)["m"].cast("double").alias("y"))
    f = selection.at_least(ev, ["game_id", "k"], 2).groupBy("game_id").agg(F.count("*").alias("n")).select("game_id", F.lit("not single").alias("kind"), F.col("n").alias("key"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e).unionByName(f)


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next actions by priority (the first thirty are the feature), the commonest kind, and the first option that exists."""
    ev = games(spark, sf_dir)
    q = selection.priority_queue(ev, [(_k() % 50 == 1, "repair"), (_k() % 20 == 2, "review"), (F.lit(True), "wait")], ["event_id"], 30).select("event_id", "next_action")
    common = selection.most_frequent(ev, "event_type").select(F.lit(-1).cast("bigint").alias("event_id"), F.concat_ws(":", F.lit("most"), "event_type").alias("next_action"))
    return q.unionByName(common)


def first_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir).select("event_id", "k")
    options = ev.select("event_id", F.posexplode(F.array(*[F.concat(F.lit("o"), (_k() * i) % 40) for i in (3, 5, 7)])).alias("rank", "option"))
    have = ev.where("k % 3 = 0").select(F.concat(F.lit("o"), _k() % 40).alias("option"))
    return selection.first_available(ev.select("event_id"), options, "event_id", "option", "rank", have)


def anchor_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's signups and errors lie from those agreed on, by episodes of three days."""
    ev = games(spark, sf_dir).where("event_type in ('signup', 'error')")
    agreed = windows.consensus(ev, "event_type", "s", "user_id", "event_id", tolerance=300, least=2).select(F.col("event_type").alias("boundary_type"), "abs_sec")
    episodes = spark.range(10).select(F.col("id").alias("episode_id"), (F.col("id") * 259200.0).alias("abs_start_sec"), ((F.col("id") + 1) * 259200.0).alias("abs_end_sec"))
    rows = ev.select(F.col("event_type").alias("boundary_type"), F.col("user_id").alias("player_id"), F.col("s").alias("aligned_start_sec"))
    out = checks.anchor_residuals(rows, agreed, episodes, roster(games(spark, sf_dir)), reach=600.0, least=2, median_limit=120.0, p95_limit=240.0)
    return out.select("episode_id", "player_id", "anchor_count", F.round("median_residual_sec", 4).alias("median_residual_sec"), F.round("p95_residual_sec", 4).alias("p95_residual_sec"), "issue")


def key_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups in which the last of a key wins, remapped ids, and patches over rows."""
    ev = games(spark, sf_dir)
    known = ev.where("k % 2 = 0").select("user_id", F.col("k").alias("last_k"), F.col("event_id").alias("seq"))
    got = joins.lookup(ev.select("event_id", "user_id"), known, ["user_id"], ["seq"]).select("event_id", "user_id", "last_k")
    patches = ev.where("k % 7 = 0").select("event_id", F.when(_k() % 2 == 0, F.lit(-5).cast("bigint")).alias("last_k"))
    patched = joins.overlay(got, patches, "event_id", ["last_k"])
    ids = ev.where("event_type <> 'view'").select("event_id", (F.col("event_id") + 100000).alias("new_id"))
    return joins.remap(patched, ids, "event_id", "new_id").select("event_id", "user_id", "last_k")


QUERIES = {f.__name__: f for f in (
    claim_scalars, vote_texts, overclaims, answer_texts, number_scalars, array_picks, answer_json, event_predicates, review_reason_rows, checker_issues, small_aggregates, work_queue, first_options, anchor_residuals, key_lookups,
)}

_G = f"WITH {EV}, {GAMES}"


def _p(*values: str | None) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][k % {len(values)} + 1]"


_I = ' SELECT "check", code, count(*) AS n_issues, min(key) AS first_key FROM i GROUP BY ALL'
_CHECKS = (
    ("evidence", "unsupported", "k % 3 > 0 AND k % 2 = 0"), ("claim_fact", "claim_taken_for_fact", "k % 6 = 0"), ("roster", "unknown_source_pov", "k % 3 = 1"), ("perspective_leakage", "hidden_id_in_text", "k % 4 = 2"), ("timed_evidence", "local_order", "k % 4 = 0"),
    ("timed_evidence", "absolute_order", "k % 4 <= CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END"), ("timed_evidence", "certainty_range", "k % 12 > 10"), ("time_formula", "start_formula", "k % 7 = 0"), ("segments", "duration_mismatch", "k % 5 = 0"),
    ("segments", "pov_count", "k % 3 <> CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END"), ("segments", "roster_mismatch", "k % 2 = 0"), ("segments", "duplicate_pov", "k % 2 = 0"), ("segments", "pov_time_mismatch", "k % 3 = 2"),
)

ORACLE_SQL = {
    "claim_scalars": _G + f""" SELECT event_id, {_p('location', 'accusation', 'sighting', 'other', 'role', 'other')} AS claim_type, {_p('defense', 'defense', 'information_sharing', 'other', 'other', 'other')} AS strategic_role, {_p('', '', 'baile', '', '', 'saoyi')} AS mentioned, [2, 3, 1, 0, 0, 2][k % 6 + 1] AS cues, {_p('accuse', 'defend', 'respond', 'respond', 'respond', 'accuse')} AS action,
        CASE WHEN k % 2 = 0 THEN 'baile' ELSE 'unknown' END AS key_speaker, {_p('他在大厅杀人', '我没投票', '看到baile', 'hello', '身份警长', 'saoyi骗你')} AS key_text, CASE WHEN k % 2 = 0 THEN 'kill' ELSE 'other' END AS event_type, CASE WHEN k % 2 = 0 THEN 'a,b' ELSE 'unknown' END AS actor, {_p('hall', 'unknown', 'room')} AS location, {_p('saoyi', 'baile', 'unknown', 'unknown')} AS player,
        {_p('他在大厅,x', '我没投票,x', '看到 b,x', 'hell,x', '身份 警,x', 'saoy,x')} AS short FROM gv""",
    "vote_texts": _G + f""", z AS (SELECT *, k % 3 AS bt, k % 6 AS v FROM gv) SELECT event_id, {_p('baile', 'saoyi', None, None)} AS voter, {_p('saoyi', None, None, None)} AS target, CASE WHEN bt = 0 THEN v IN (0) WHEN bt = 1 THEN v = 1 ELSE false END AS ok,
        CASE v WHEN 1 THEN '鹈鹕胜利' WHEN 5 THEN '鸭子阵营失败' ELSE CASE bt WHEN 0 THEN '失败' WHEN 1 THEN '胜利' ELSE '结果' END END AS result, CASE WHEN k % 3 = 1 THEN 'note' ELSE {_p('西班牙语', '德语', '未知', '法语', '俄语')} END AS language FROM z""",
    "overclaims": _G + """ SELECT event_id, k % 8 IN (0, 1, 4, 7) AS death, k % 5 = 0 OR (k % 2 = 0 AND k % 3 < 2) AS oracle FROM gv""",
    "answer_texts": _G + f""" SELECT event_id, ['B', 'a long line' || chr(10) || 'no letter', 'Yes, it is', '不 是的', 'no', 'answer A'][k % 6 + 1] AS letter, {_p('B', 'A', 'A', 'A', 'B', 'A')} AS yes_no, CASE WHEN k % 2 = 0 THEN 7.5 ELSE 1.0 END AS number, CASE WHEN k % 3 = 1 THEN 'given' WHEN k % 3 = 0 THEN 'meeting' ELSE 'unknown' END AS phase, k % 2 = 0 AS leaked,
        CASE WHEN k % 2 = 0 THEN 'oracle,an' ELSE 'an' END AS flags, {_p('baile', 'saoyi', '')} AS speaker, {_p('says go home', 'asked why', 'just this')} AS content, k % 3 < 2 AS split, CASE WHEN k % 2 = 0 THEN 'baile' ELSE 'x' END AS description FROM gv""",
    "number_scalars": _G + """, z AS (SELECT *, s - 5 + k % 3 * 100 AS a, e - 90 + k % 3 * 100 AS b FROM gv), y AS (SELECT *, greatest(s, a) AS cs, least(e, b) AS ce FROM z), x AS (SELECT *, least(e, greatest(ce, cs + 1)) AS lg FROM y)
        SELECT event_id, k - 1 >= 0 AND k + 5 <= 60.000001 AS local_ok, CASE WHEN cs < e THEN greatest(s, least(cs, lg - 1)) ELSE s END AS clip_start, CASE WHEN cs < e THEN lg ELSE e END AS clip_end, 1.5 * s - 40 AS raw_start, 1.5 * s - 40 >= 0 AND 1.5 * e - 40 <= 2000000.000001 AS raw_ok, greatest(greatest(0.0, s - 8), e + 8 - 60) AS context_start, e + 8 AS context_end,
            greatest(s, s + k % 9 - 3) AS span_start, greatest(least(e, s + k % 9 + 4), greatest(s, s + k % 9 - 3) + 0.5) AS span_end, printf('%02d:%02d:%02d', CAST(floor(s / 3600) AS BIGINT), CAST(floor(s / 60) AS BIGINT) % 60, CAST(s AS BIGINT) % 60) AS clock, CAST([0.4, 0.25, 1.0][k % 3 + 1] AS DOUBLE) AS clamped, [true, false, true, true][k % 4 + 1] AS flag, (e - s - 20) / (e - s + 20) AS iou, s + k AS absolute FROM x""",
    "array_picks": _G + f""", z AS (SELECT *, [{{'c': (k * i + 3) % 7, 'r': (k + i) % 2, 'i': i}} FOR i IN [1, 2, 3, 4]] AS t FROM gv),
        y AS (SELECT *, list_sort([{{'a': -x.c, 'b': -x.r, 'i': x.i}} FOR x IN t]) AS p, list_sort([{{'a': -x.r, 'b': -x.c, 'i': x.i}} FOR x IN t]) AS q FROM z)
        SELECT event_id, 'i' || p[1].i || ',i' || p[2].i AS by_certainty, 'i' || q[1].i || ',i' || q[2].i AS by_review, 'i3,i4' AS tail, CASE WHEN k % 2 = 0 THEN 'x,z' ELSE 'x,y,z' END AS options, CASE WHEN k % 2 = 0 THEN 'B' ELSE 'C' END AS letter, CASE WHEN k % 2 = 1 THEN 'b' ELSE 'c' END AS preferred, CASE WHEN k % 2 = 0 THEN 'e2' ELSE 'e1,e2' END AS subject_only, CASE WHEN k % 2 = 0 THEN 'z' ELSE 'a' END AS other,
            CASE WHEN k % 2 = 0 THEN 'a b' ELSE 'a b|c' END AS unique FROM y""",
    "answer_json": _G + """ SELECT event_id, 'a,b' || k || ',c,ev' || (k % 3) AS cited, 'a,b' || k AS evidence, CAST(NULL AS VARCHAR) AS first, k % 2 = 0 AS matches, k % 3 = 0 AND (k % 3 = 1 OR contains('b' || k, 'ev1')) AS forbidden, k % 3 = 1 AS has_value, true AS stripped, '{"public_history":["p0","p1"],"heard_claims":["h"]}' AS context, sha256('{"a":' || k || ',"b":1}') AS hash, CASE WHEN k % 2 = 0 THEN 't|m' ELSE 'u|m' END AS task_key FROM gv""",
    "event_predicates": _G + f""", z AS (SELECT *, k % 10 / 10 AS c, k % 20 AS len, k % 30 >= 15 OR k % 3 = 1 AS warm, k % 4 = 0 OR k % 4 = 2 AS pr FROM gv)
        SELECT event_id, k % 3 <> 1 AND k % 4 IN (0, 2) AND k % 3 <> 1 AND c >= 0.65 AND k % 6 <> 0 AND k % 2 = 0 AND (k % 30 >= 0 AND (10.0 + k % 30) - 10 >= 15) AS clean, k % 2 = 1 AND k % 2 = 0 AS usable, k % 2 = 1 OR (len BETWEEN 0 AND 15 AND c >= 0.6 AND k % 4 IN (0, 2) AND k % 3 <> 9 AND length({_p('a plain thing', 'voting now', '尸体 here')}) >= 8) AS allowed,
            CAST(CASE WHEN k % 4 = 0 THEN 80 WHEN k % 3 = 2 THEN 70 ELSE 45 END + CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 18 WHEN 2 THEN 10 ELSE 0 END + CASE WHEN k % 3 <> 1 THEN 14 ELSE 0 END + 2 * least(10, floor(c * 10)) AS BIGINT) AS gold_rank FROM z""",
    "review_reason_rows": _G + """, z AS (SELECT *, k % 3 < 2 AS hid FROM gv) SELECT event_id, array_to_string(list_filter([CASE WHEN k % 4 = 0 THEN 'group_needs_review' END, CASE WHEN k % 6 = 0 THEN 'anchor_event_needs_review' END, CASE WHEN k % 5 < 2 THEN 'anchor_event_starts_after_cutoff' END, CASE WHEN hid AND k % 20 > k % 5 - 2 THEN 'anchor_event_extends_after_cutoff' END, CASE WHEN hid AND k % 2 = 0 THEN 'target_is_source' END], lambda x: x IS NOT NULL), ',') AS metadata,
        ['claim_truth_vs_claim_awareness,route_belief,perspective_taking,vote_influence', 'claim_truth_vs_claim_awareness,perspective_taking,vote_influence', ''][k % 3 + 1] AS uses FROM z""",
    "checker_issues": _G + ", z AS (SELECT printf('r%08d', event_id) AS f, k, s, e FROM gv), i AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS "check", '{n}' AS code, f AS key FROM z WHERE {w}""" for c, n, w in _CHECKS) + ")" + _I,
    "small_aggregates": _G + """, st AS (SELECT game_id, 'state' AS kind, user_id AS key, CAST(count(*) AS DOUBLE) AS x, round(least(1.0, avg(floor(value) / 64)), 6) AS y FROM gv GROUP BY game_id, user_id), d AS (SELECT count(*) AS n FROM gv GROUP BY game_id, k HAVING count(*) > 1)
        FROM st UNION ALL SELECT -1, 'language ' || CASE WHEN k % 2 = 0 THEN 'de' ELSE 'en' END, count(*), CAST(count(*) FILTER (k % 2 = 0) AS DOUBLE), round(avg(k % 5) FILTER (k % 2 = 0), 6) FROM gv GROUP BY k % 2 UNION ALL SELECT -1, 'duplicates', count(*), CAST(max(n) AS DOUBLE), 0.0 FROM d
        UNION ALL SELECT game_id, 'first', arg_min(k, event_id) FILTER (k > 50), 0.0, 0.0 FROM gv GROUP BY game_id UNION ALL SELECT game_id, 'segment', k % 4, CAST(count(*) AS DOUBLE), CAST(min(event_id) AS DOUBLE) FROM gv GROUP BY game_id, k % 4
        UNION ALL SELECT game_id, 'not single', CAST(sum(n) AS BIGINT), 0.0, 0.0 FROM (SELECT game_id, count(*) AS n FROM gv GROUP BY game_id, k HAVING count(*) > 1) q GROUP BY game_id""",
    "work_queue": _G + """, q AS (SELECT event_id, CASE WHEN k % 50 = 1 THEN 0 WHEN k % 20 = 2 THEN 1 ELSE 2 END AS p FROM gv), t AS (SELECT * FROM q ORDER BY p, event_id LIMIT 30) SELECT event_id, ['repair', 'review', 'wait'][p + 1] AS next_action FROM t
        UNION ALL (SELECT -1, 'most:' || event_type FROM gv GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)""",
    "first_options": _G + """, h AS (SELECT DISTINCT k % 40 AS o FROM gv WHERE k % 3 = 0), x AS (SELECT event_id, unnest([k * 3 % 40, k * 5 % 40, k * 7 % 40]) AS o, unnest([0, 1, 2]) AS r FROM gv), m AS (SELECT event_id, arg_min(o, r) AS o FROM x JOIN h USING (o) GROUP BY event_id) SELECT event_id, 'o' || o AS option FROM gv LEFT JOIN m USING (event_id)""",
    "anchor_residuals": _G + """, b AS (SELECT * FROM gv WHERE event_type IN ('signup', 'error')), n AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY event_type ORDER BY s) > 300 THEN 1 ELSE 0 END AS new FROM b), c AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY s ROWS UNBOUNDED PRECEDING) AS cl FROM n),
        g AS (SELECT event_type, cl, median(s) AS a FROM c GROUP BY event_type, cl HAVING count(DISTINCT user_id) >= 2), ep AS (SELECT unnest(range(0, 10)) AS ep), pl AS (SELECT ep, ep * 259200.0 AS lo, (ep + 1) * 259200.0 AS hi, event_type, cl, a FROM ep JOIN g ON a BETWEEN ep * 259200.0 AND (ep + 1) * 259200.0),
        r AS (SELECT ep, user_id, event_type, cl, a, min(abs(s - a)) AS d FROM pl JOIN b USING (event_type) WHERE abs(s - a) <= 600 AND s BETWEEN lo AND hi GROUP BY ALL), t AS (SELECT ep, user_id, count(*) AS n, median(d) AS m, list_sort(list(d))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1] AS p FROM r GROUP BY ep, user_id)
        SELECT e.ep AS episode_id, u.player_id, coalesce(n, 0) AS anchor_count, round(m, 4) AS median_residual_sec, round(p, 4) AS p95_residual_sec, CASE WHEN coalesce(n, 0) < 2 THEN 'few_anchors' WHEN m > 120 THEN 'median_residual' WHEN p > 240 THEN 'p95_residual' END AS issue FROM ep e CROSS JOIN roster u LEFT JOIN t ON t.ep = e.ep AND t.user_id = u.player_id""",
    "key_lookups": _G + """, l AS (SELECT user_id, arg_max(k, event_id) AS lk FROM gv WHERE k % 2 = 0 GROUP BY user_id) SELECT event_id + 100000 AS event_id, gv.user_id, CASE WHEN k % 14 = 0 THEN -5 ELSE lk END AS last_k FROM gv LEFT JOIN l ON l.user_id = gv.user_id WHERE event_type <> 'view'""",
}

#: Columns whose literals DuckDB would take for narrower types.
for _name, _types in {
    "claim_scalars": {"cues": "BIGINT"},
    "answer_texts": {"number": "DOUBLE"},
}.items():
    _casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _types.items())
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE_SQL[_name]}) AS q"
