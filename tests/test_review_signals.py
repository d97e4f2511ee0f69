import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import signals
from tidewright.operators import aggregates, series
from tidewright.plans import review


def test_envelope_and_correlation(spark):
    rng = np.random.default_rng(3)
    long = rng.normal(size=900)
    assert signals.best_offset(long, long[400:500]) == (400, pytest.approx(1.0))
    assert signals.best_offset(long[:5], long) == (-1, 0.0) and signals.best_offset(np.zeros(9), np.zeros(3)) == (0, 0.0)
    e = signals.envelope_of(rng.normal(size=1003), 10)
    assert len(e) == 100 and e.mean() == pytest.approx(0) and e.std() == pytest.approx(1)
    target = np.concatenate([rng.normal(size=37), long])
    df = spark.createDataFrame([("p", long.tolist(), target.tolist())], "k string, a array<double>, b array<double>")
    rows = signals.local_anchors(df, "k", "a", "b", 10.0, 20.0, 8.0, 6.0).collect()
    assert len(rows) == 5 and all(r.target_sec - r.reference_sec == pytest.approx(3.7) and r.score > 0.99 for r in rows)
    got = df.select(signals.envelope("a", F.lit(10)).alias("e"), signals.correlate("b", F.slice("a", 1, 200)).alias("c")).first()
    assert len(got.e) == 90 and got.c.position == 37


EVENT = "struct<phase_type: string, event_type: string, source_segment_ids: array<string>, abs_start_sec: double, abs_end_sec: double, description: string, location: string, actors: array<string>, source_povs: array<string>, certainty: double, needs_human_review: boolean>"
CLAIM = "struct<speaker: string, claim_type: string, content: string, heard_by: array<string>, source_segment_ids: array<string>, abs_start_sec: double, abs_end_sec: double, certainty: double>"


def test_spec_reasons(spark):
    event = ("gameplay", "kill", ["g_gameplay_000100_000200"], 150.0, 152.0, "bo strikes", "hall", ["bo"], ["cy"], 0.9, False)
    claim = ("bo", "defense", "I was never in there", ["ana", "bo", "cy", "di"], ["g_meeting_000200_000260"], 230.0, 233.0, 0.9)
    bad_event = ("meeting", "vote", ["g_meeting_000100_000200"], 150.0, 500.0, "voting screen", " ", ["cy"], ["ana"], 0.2, True)
    bad_claim = ("zed", "chat", "no", [], ["g_meeting_000200_000260"], 205.0, 206.0, 0.1)
    df = spark.createDataFrame([(event, claim, "ana", "contradicted", "not_visible"), (bad_event, bad_claim, "ana", "contradicted", None)], f"event {EVENT}, claim {CLAIM}, target string, truth string, visibility string")
    players = F.array(*[F.lit(p) for p in ("ana", "bo", "cy", "di")])
    truth = [r[0] for r in df.select(review.claim_truth_reasons(players, ["vote"], ["kill"])).collect()]
    assert truth[0] == [] and len(truth[1]) == 14
    reveal = [r[0] for r in df.select(review.delayed_reveal_reasons(F.col("target") == "ana", claim_types=["defense"])).collect()]
    assert reveal[0] == [] and set(reveal[1]) == {"target_is_source", "reveal_claim_too_close_to_phase_start", "reveal_too_close_to_event", "claim_not_public_enough", "claim_type_not_reveal", "claim_not_after_event"}


def test_uses_and_decisions(spark):
    rows = spark.createDataFrame([("location", "accuse"), ("role_claim", None), (None, "ask_for_information")], "t string, f string")
    assert [r[0] for r in rows.select(review.probe_uses(F.col("t"), F.col("f"))).collect()] == [["claim_truth_vs_claim_awareness", "route_belief", "perspective_taking", "vote_influence"], ["claim_truth_vs_claim_awareness"], ["perspective_taking"]]
    items = spark.createDataFrame([(["x"], "hi", [], "ana"), ([], " ", [], "ana"), ([], "hi", ["zed"], "ana"), ([], "hi", [], "zed"), ([], "hi", ["ana"], "ana"), ([], "hi", [], "ana")], "i array<string>, s string, t array<string>, w string")
    got = items.select(review.conservative_decision(F.col("i"), F.col("s"), F.col("t"), F.col("w"), F.array(F.lit("ana")))).collect()
    assert [r[0] for r in got] == ["reject_for_gold"] * 3 + ["needs_speaker_and_audio_confirmation", "needs_alias_and_audio_confirmation", "needs_audio_confirmation"]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", "x"), ("a", ""), (None, "x")], "k string, v string")
    assert {tuple(r) for r in aggregates.counters(df, ["k", "v"]).collect()} == {("k", "a", 2), ("k", "unknown", 1), ("v", "x", 2), ("v", "unknown", 1)}
    out = spark.createDataFrame([("s1", "pov"), ("s1", "pov"), ("s1", "merge"), ("s2", "pov")], "seg string, stage string")
    done = {r.seg: r.next_action for r in aggregates.stage_completeness(out, "seg", "stage", ["pov", "merge"], {"pov": 2}).collect()}
    assert done == {"s1": "complete", "s2": "pov"}
    ev = spark.createDataFrame([("p", 2.0, "b", 0.5), ("p", 1.0, "a", 1.0)], "p string, e double, d string, c double")
    r = aggregates.player_states(ev, ["p"], "e", "d", "c").first()
    assert (r.cutoff_time, r.known_facts, r.confidence) == (2.0, ["a", "b"], 0.75)
    assert aggregates.first_where(ev, ["p"], "e", F.col("c") < 1, "d").first().d == "b"
    assert {r.k: r.n for r in aggregates.summed([aggregates.count_by(df, "k").withColumnRenamed("n", "n")] * 2, "k", "n").collect()} == {"a": 4, "unknown": 2}
    clips = spark.createDataFrame([("g", 0.0, "bo", "f2"), ("g", 0.0, "ana", "f1")], "g string, s double, p string, f string")
    assert [m.p for m in aggregates.segment_assembly(clips, ["g", "s"], "p", ["f"]).first().members] == ["ana", "bo"]


def sampled(spark, arrays, drop=()):
    rows = [(k, i, float(v)) for k, a in arrays.items() for i, v in enumerate(a) if i not in drop]
    return spark.createDataFrame(rows, "k string, at long, value double").repartition(3)


@pytest.mark.parametrize("size", [8, 32, 256])
def test_blocks_correlate_as_one_transform(spark, size):
    """Both sides longer than a block, shorter than one, equal in length, and a query that is too long."""
    rng = np.random.default_rng(size)
    search = {"a": rng.normal(size=500), "b": rng.normal(size=100), "c": rng.normal(size=40), "d": rng.normal(size=9), "e": np.zeros(50), "f": np.append(np.zeros(200), rng.normal(size=60))}
    query = {"a": search["a"][277:377] * 2, "b": search["b"][93:100], "c": search["c"], "d": rng.normal(size=30), "e": rng.normal(size=5), "f": search["f"][210:250]}
    got = {r.k: (r.position, r.score) for r in series.correlate(sampled(spark, search, drop=(3,)), sampled(spark, query), ["k"], size=size).collect()}
    for k in search:
        gap = search[k].copy()
        gap[3] = 0
        position, score = signals.best_offset(gap, query[k])
        assert got[k] == ((0 if k == "e" else position), pytest.approx(score, abs=1e-6))
    assert got["a"] == (277, pytest.approx(1.0)) and got["d"] == (-1, 0.0) and len(got) == 6


def test_envelopes_and_anchors_of_long_series(spark):
    rng = np.random.default_rng(1)
    samples = rng.normal(size=1003)
    e = series.envelope(sampled(spark, {"a": samples}), ["k"], "at", "value", 10).orderBy("at").collect()
    assert [r.value for r in e] == pytest.approx(signals.envelope_of(samples, 10).tolist())
    reference = rng.normal(size=900)
    target = np.append(rng.normal(size=25), reference)[:880]
    found = series.local_anchors(sampled(spark, {"p": reference}), sampled(spark, {"p": target}), ["k"], 10.0, 20.0, 8.0, 6.0, size=64).orderBy("reference_sec").collect()
    arrays = spark.createDataFrame([("p", reference.tolist(), target.tolist())], "k string, a array<double>, b array<double>")
    want = signals.local_anchors(arrays, "k", "a", "b", 10.0, 20.0, 8.0, 6.0).orderBy("reference_sec").collect()
    assert [tuple(r)[:3] for r in found] == [tuple(r)[:3] for r in want] and len(found) > 3
    assert [r.score for r in found] == pytest.approx([r.score for r in want])
