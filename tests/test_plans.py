import json

import pytest
from pyspark.sql import functions as F

from tidewright.plans import checks, evaluation, ledger, scoring, stages, trajectory
from tidewright.sources.commits import CommitLog

PLAYERS = ("ana", "bo", "cy")


@pytest.fixture(scope="module")
def players(spark):
    return spark.createDataFrame([(p,) for p in PLAYERS], "player_id string")


def annotation(phase, player, kind, observations=(), utterances=()):
    start = 400.0 if kind == "gameplay" else 418.0
    return {"game_id": "g1", "episode_id": "g1_e0", "phase_id": phase, "phase_type": kind, "phase_index_global": int(kind != "gameplay"), "player_id": player, "aligned_start_sec": start, "aligned_end_sec": start + 90, "observations": list(observations), "utterances": list(utterances)}


@pytest.fixture(scope="module")
def annotations(spark):
    """One player saw another near a body, twice; in the meeting that player denies it, heard in all three views."""
    seen = {"abs_start_sec": 410.0, "abs_end_sec": 414.0, "event_type": "near_body", "actor": "bo", "location": "hall", "description": "cy sees bo pass the body", "source_types": ["direct_visual_observation"], "evidence": "seen", "certainty": "0.9"}
    said = {"abs_start_sec": 418.2, "abs_end_sec": 423.5, "speaker": "bo", "transcript": "我刚才一直在下面，没有去过右边。", "certainty": "0.85"}
    rows = [annotation("p0_gameplay_000400_000490", p, "gameplay", [seen, {**seen, "abs_start_sec": 411.0, "abs_end_sec": 414.5, "evidence": "again"}] if p == "cy" else []) for p in PLAYERS]
    rows += [annotation("p1_meeting_000418_000508", p, "meeting", [], [said]) for p in PLAYERS]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string")
    parsed = lines.select(F.from_json("v", F.lit(" ".join(ledger.ANNOTATION.split()))).alias("a")).select("a.*")
    return parsed.withColumn("path", F.concat_ws("/", "phase_id", "player_id"))


@pytest.fixture(scope="module")
def tables(annotations, players):
    return {k: v.cache() for k, v in ledger.build_ledger(annotations, players).items()}


def test_ledger(tables, players):
    event = tables["world_events"].collect()
    assert len(event) == 1
    e = event[0]
    assert (e.world_event_id, e.abs_start_sec, e.abs_end_sec, e.source_povs, e.actors) == ("ge_000001", 410.0, 414.5, ["cy"], ["bo"])
    assert e.direct_visual_evidence == ["seen", "again"] and len(e.duplicate_local_event_ids) == 2
    claims = tables["claims"].collect()
    assert len(claims) == 1 and claims[0].speaker == "bo" and claims[0].claim_type == "location" and claims[0].heard_by == list(PLAYERS) and claims[0].time_referred == "relative_recent"
    edges = {(r.event_id, r.player_id): r.visibility for r in tables["visibility_edges"].collect()}
    assert edges == {("ge_000001", "ana"): "not_visible", ("ge_000001", "bo"): "not_visible", ("ge_000001", "cy"): "direct_visual", **{("claim_000001", p): "heard_claim" for p in PLAYERS}}
    link = tables["claim_truth_links"].collect()[0]
    assert link.truth_status_global == "contradicted" and link.world_event_ids == ["ge_000001"]
    assert link.local_awareness_by_player == {"ana": "not_enough_information", "bo": "not_enough_information", "cy": "has_contradictory_visual_evidence"}
    assert tables["phase_events"].count() == 2 and tables["canonical_event_map"].count() == 2
    snaps = {(r.target_player, r.cutoff_abs_sec): r for r in tables["belief_memory_snapshots"].collect()}
    late, early = snaps[("ana", 424.5)], snaps[("cy", 417.5)]
    assert late.forbidden_event_ids == ["ge_000001"] and late.heard_claims == ["claim_000001"] and late.private_observations == []
    assert early.private_observations == ["obs_cy_ge_000001"] and early.heard_claims == []
    assert checks.ledger_rows(tables, players).count() == 0


def test_probes(tables):
    groups = ledger.select_probe_groups(tables, 10)
    rows = groups.collect()
    assert {(r.template, r.target_player) for r in rows} >= {("hidden_critical_event", "ana"), ("contradicted_alibi", "ana"), ("private_witness", "bo")}
    probes = ledger.probe_rows(groups, tables).collect()
    assert {r.letter for r in probes if r.template == "contradicted_alibi"} == set("ABCD")
    assert {r.letter for r in probes if not r.claim_ids} <= set("ABC")
    assert all("forbidden" not in c for c in ledger.public_probe(ledger.probe_rows(groups, tables)).columns)
    seen = {r.event_id: (r.direct, r.hidden) for r in ledger.direct_and_hidden(tables["visibility_edges"]).collect()}
    assert seen["ge_000001"] == (["cy"], ["ana", "bo"])


def test_ledger_checks_find_faults(tables, players):
    bad = dict(tables)
    bad["visibility_edges"] = tables["visibility_edges"].where("player_id <> 'ana'").unionByName(tables["visibility_edges"].where("player_id = 'bo'"))
    bad["world_events"] = tables["world_events"].withColumn("abs_end_sec", F.lit(0.0))
    bad["claims"] = tables["claims"].limit(0)
    found = {r.code for r in checks.ledger_rows(bad, players).collect()}
    assert found == {"missing_edge", "duplicate_id", "time_order", "unknown_reference"}


NODE = dict(public_ui=False, confidence=0.9, speaker_id=None, speaker_confidence=None, utterance=None, visible_players=[], mentioned_players=[], heard_by=[], meeting_public=False, visual_text_evidence_id=None, location="x", description="d", episode_id="e0", phase_index=0, phase_type="gameplay")
SCHEMA = """modality string, player_id string, event_type string, start_sec double, end_sec double, public_ui boolean, confidence double, speaker_id string, speaker_confidence double, utterance string,
    visible_players array<string>, mentioned_players array<string>, heard_by array<string>, meeting_public boolean, visual_text_evidence_id string, evidence_id string, episode_id string, phase_index int, phase_type string, location string, description string, seq int"""


def test_trajectory_and_states(spark, players):
    said = dict(speaker_id="bo", speaker_confidence=0.95, utterance="I  was here")
    rows = [
        dict(modality="visual", player_id="ana", event_type="vote", start_sec=1.0, end_sec=2.0, public_ui=True, evidence_id="v1"), dict(modality="visual", player_id="bo", event_type="vote", start_sec=2.0, end_sec=3.0, public_ui=True, evidence_id="v2"),
        dict(modality="visual", player_id="cy", event_type="vote", start_sec=3.0, end_sec=4.0, public_ui=True, evidence_id="v3"),  # 2 s after the first: a group of its own
        dict(modality="visual", player_id="ana", event_type="movement", start_sec=5.0, end_sec=6.0, evidence_id="m1", visible_players=["cy", "bo"]), dict(modality="visual", player_id="bo", event_type="movement", start_sec=5.0, end_sec=6.0, evidence_id="m2"),
        dict(modality="audio", player_id="ana", event_type="claim", start_sec=7.0, end_sec=8.0, evidence_id="a1", **said), dict(modality="audio", player_id="cy", event_type="claim", start_sec=7.5, end_sec=8.0, evidence_id="a2", **{**said, "utterance": "i was HERE"}),
        dict(modality="audio", player_id="cy", event_type="claim", start_sec=9.0, end_sec=9.5, evidence_id="a3", **{**said, "speaker_confidence": 0.5}), dict(modality="visual", player_id="ana", event_type="kill", start_sec=99.0, end_sec=100.0, evidence_id="k1"),
    ]
    cols = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
    df = spark.createDataFrame([tuple({**NODE, **r, "seq": i}[c] for c in cols) for i, r in enumerate(rows)], SCHEMA)
    episodes = spark.createDataFrame([("e0", 0.0, 50.0)], "episode_id string, abs_start_sec double, abs_end_sec double")
    nodes = trajectory.fuse(df, episodes).cache()
    got = {r.trajectory_node_id: r for r in nodes.collect()}
    assert sorted(tuple(r.evidence_asset_ids) for r in got.values()) == [("a1", "a2"), ("a3",), ("m1",), ("m2",), ("v1", "v2"), ("v3",)]
    by = {tuple(r.evidence_asset_ids): r for r in got.values()}
    vote, talk, lone = by[("v1", "v2")], by[("a1", "a2")], by[("a3",)]
    assert vote.public_ui and vote.source_povs == ["ana", "bo"] and vote.abs_end_sec == 3.0 and vote.audio_admissible is None
    assert talk.audio_admissible and talk.utterance == "I  was here" and talk.heard_by == ["ana", "cy"]
    assert lone.audio_admissible is False and lone.speaker_id is None and lone.heard_by == []
    states = trajectory.information_states(nodes, players).cache()
    s = {(r.player_id, r.cutoff_abs_sec): r for r in states.collect()}
    assert s[("cy", 3.0)].public_history == sorted([vote.trajectory_node_id, by[("v3",)].trajectory_node_id])
    assert s[("cy", 6.0)].private_observations == [] and by[("m1",)].trajectory_node_id in s[("cy", 6.0)].forbidden_events
    assert s[("ana", 8.0)].private_observations == sorted([by[("m1",)].trajectory_node_id, talk.trajectory_node_id])
    assert all(set(r.known_facts).isdisjoint(r.forbidden_events) for r in s.values())
    evidence = trajectory.layer_evidence(states, nodes, players)
    found = {(r.subject, r.target, r.layer): r.evidence_ids for r in evidence.where("cutoff_abs_sec = 8.0").collect()}
    assert found[("ana", "cy", "perception_access")] == ["m1"] and found[("ana", "bo", "belief_and_false_belief")] == ["a1", "a2"]
    trials = trajectory.trials(evidence, states)
    assert checks.trial_rows(trials).count() == 0 and trials.select("variant").distinct().count() == 4
    asks = evidence.select("information_state_id", F.lit("e0").alias("episode_id"), "target", "cutoff_abs_sec", F.concat_ws("|", "information_state_id", "target", "layer").alias("ask"))
    nxt = {r.ask: r.next_event_type for r in trajectory.next_behaviour(asks, nodes, "ask").collect()}
    assert all(v in ("vote", "movement", "claim") for v in nxt.values()) and nxt


def test_diagnostic_scores(spark):
    answers = [
        ("g1", "A_x", '{"knows_truth": false, "belief_label": "thinks X"}'), ("g1", "B_x", '{"target_knew_truth_at_cutoff": false, "belief_label": "she thinks X indeed", "evidence_ids": ["ev1"]}'),
        ("g1", "C_x", '{"other_player_knew_truth_at_cutoff": false, "other_player_likely_belief": "y"}'), ("g1", "D_x", '{"listener": "bo", "speaker": "cy", "predicted_trust_update": "down", "predicted_next_action": "vote", "claim_truth_global": "true", "target_can_know_claim_truth": false}'),
        ("g2", "A_x", "not json"), ("g2", "B_x", '{"target_knew_truth_at_cutoff": true, "belief_label": "z", "note": "hid9"}'),
    ]
    table = scoring.answer_table(spark.createDataFrame([(*a, i) for i, a in enumerate(answers)], "probe_group_id string, probe_type string, raw_response string, seq int"))
    gold = table.withColumns({"forbidden": F.array(F.lit("hid9")), "acceptable": F.array(F.lit("ev1")), "expected_global": F.lit("supported"), "expected_local": F.lit("not enough information"), "ref_listener": F.lit("bo"), "ref_speaker": F.lit("cy")})
    rows = {r.probe_group_id: r for r in scoring.score_groups(gold).collect()}
    g1, g2 = rows["g1"], rows["g2"]
    assert all(g1[c] is True for c in ("RC_weak", "RC_strong", "FB_weak", "FB_strong", "PT_weak", "PT_strong", "claim_verification_global", "claim_verification_local", "evidence_support", "json_parse_success", "schema_validation_success")) and not g1.perspective_leakage
    assert g2.RC_weak is False and g2.FB_weak is None and g2.PT_weak is None and g2.perspective_leakage and not g2.evidence_support and not g2.json_parse_success and not g2.schema_validation_success
    rates = scoring.diagnostic_rates(scoring.score_groups(gold)).first()
    assert rates.groups_scored == 2 and rates.FB_weak == 0.5 and rates.perspective_leakage == 0.5


def test_check_tables(spark, players):
    roster = F.array(*[F.lit(p) for p in PLAYERS])
    hearing = spark.createDataFrame([("c1", ["ana", "bo", "cy"], False, "bo", True), ("c2", None, False, None, True), ("c3", ["zed"], True, "zed", False)], "id string, heard_by array<string>, meeting_public boolean, speaker_id string, audio_admissible boolean").withColumn("visual_text_evidence_id", F.lit(None).cast("string"))
    assert {(r.key, r.code) for r in checks.claim_hearing(hearing, "id", roster).collect()} == {("c1", "private_heard_by_all"), ("c2", "no_heard_by"), ("c3", "unknown_hearer"), ("c3", "unknown_speaker"), ("c3", "no_evidence")}
    maps = spark.createDataFrame([("ana", 1.0, 0.0, 5, 0.2, 0.4), ("bo", 1.2, 0.0, 2, 3.0, 9.0)], "player_id string, scale double, offset double, inlier_count int, median_residual_sec double, p95_residual_sec double")
    assert {(r.key, r.code) for r in checks.alignment(maps, players).collect()} == {("bo", "few_anchors"), ("bo", "median_residual"), ("bo", "p95_residual"), ("bo", "scale_range"), ("cy", "missing_mapping")}
    phases = spark.createDataFrame([("e", 0, 0.0, 5.0), ("e", 1, 6.0, 8.0), ("e", 2, 7.0, 7.0)], "e string, phase_index int, abs_start_sec double, abs_end_sec double")
    assert {(r.key, r.code) for r in checks.contiguous_phases(phases, "e").collect()} == {("e|1", "gap"), ("e|2", "overlap"), ("e|2", "empty_phase")}
    rows = spark.createDataFrame([("c", float(10 * i), float(10 * i + 5), "task_ui" if i else "odd", "same thing") for i in range(4)], "clip string, start_sec double, end_sec double, event_type string, description string")
    assert {r.code for r in checks.perception_pass(rows, ["clip"], ["task_ui"]).collect()} == {"forbidden_type", "templated_descriptions", "repeated_description", "uniform_grid"}
    lines = spark.createDataFrame([("f1", 'x "hidden_gold": 1'), ("f2", "clean")], "path string, body string")
    assert [(r.key, r.detail) for r in checks.leak_scan(lines, "public", "path", "body", ["hidden_gold", "forbidden"]).collect()] == [("f1", "hidden_gold")]
    one, two = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert sorted((r.key, r.detail) for r in checks.id_sets("ids", {"a": one, "b": two}, "id").collect()) == [("1", "b"), ("3", "a")]
    assert checks.row_count(one, "n", 2).count() == 0 and checks.row_count(one, "n", 3).count() == 1 and checks.row_count(one, "n", two).count() == 0
    review = spark.createDataFrame([("t1", "accept", "why", ["e1"], None), ("t2", "maybe", " ", ["zz"], None), ("t3", "repair", "r", [], None)], "id string, decision string, reason string, evidence_ids array<string>, final_value string")
    assert {(r.key, r.code) for r in checks.judgement(review, "id", F.array(F.lit("e1"))).collect()} == {("t2", "unknown_decision"), ("t2", "no_reason"), ("t2", "foreign_evidence"), ("t3", "repair_without_value")}
    assert sorted((r.key, r.code) for r in checks.review_shards(one, one.unionByName(two), "id").collect()) == [("2", "duplicate"), ("3", "unexpected")]
    found = review.select(checks.rejectable(F.array("id"), ["t1"], ["t3"])).collect()
    assert [r[0] for r in found] == [True, False, True]


def test_stage_runner(spark, tmp_path):
    calls = []

    def first(spark, before, config):
        calls.append("first")
        return spark.range(config["n"])

    def second(spark, before, config):
        calls.append("second")
        if config.get("broken", {}).get("now"):
            raise RuntimeError("broken")
        return before["first"].selectExpr("id * 2 AS id")

    broken = {"now": True}
    run = stages.StageRunner(spark, str(tmp_path / "r"), {"n": 3, "broken": broken}, [("first", first), ("second", second)])
    with pytest.raises(RuntimeError):
        run.run()
    assert run.status() == {"first": "complete", "second": "failed"}
    broken["now"] = False
    assert run.run() == ["second"] and calls == ["first", "second", "second"]
    assert run.run() == [] and [r.id for r in run.output("second").orderBy("id").collect()] == [0, 2, 4]
    assert run.run(from_stage="second") == ["second"]
    other = stages.StageRunner(spark, str(tmp_path / "r"), {"n": 4}, [("first", first)])
    with pytest.raises(ValueError):
        other.run()
    with pytest.raises(ValueError):
        run.run(to_stage="third")
    with pytest.raises(ValueError):
        run.run(from_stage="second", to_stage="first")
    waiting = stages.StageRunner(spark, str(tmp_path / "w"), {"n": 2}, [("first", first), ("second", None), ("third", first)])
    assert waiting.run() == ["first"] and waiting.status() == {"first": "complete", "second": "pending"}
    with pytest.raises(ValueError):
        waiting.output("third")


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert stages.append_once(rows, path, "id") == 2 and stages.append_once(rows, path, "id") == 0
    assert stages.append_once(spark.createDataFrame([(2, "z"), (3, "c")], "id int, v string"), path, "id") == 1
    assert sorted(CommitLog(spark, path).read().collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_evaluation_run(spark):
    tasks = spark.createDataFrame([("t1", "hello"), ("t2", "please fail")], "trial_id string, prompt string")
    plan = evaluation.plan(tasks, evaluation.registry(spark), evaluation.modalities(spark), "v1")
    assert plan.count() == 18 and plan.where("supported").count() == 12
    got = evaluation.run(plan)
    rows = {r.task_key: r for r in got.collect()}
    assert rows["t1|mock-text|text|v1"].schema_ok and rows["t2|mock-text|text|v1"].status == "ok" and not rows["t2|mock-text|text|v1"].parse_ok
    assert rows["t1|mock-text|video|v1"].status == "skipped"
    assert evaluation.run(plan, completed=got).count() == 0

    def flaky(prompt):
        raise TimeoutError("slow")

    failed = evaluation.run(plan.limit(1).withColumn("supported", F.lit(True)), flaky).first()
    assert failed.status == "error" and failed.attempts == 2 and "slow" in failed.error
    assert evaluation.markdown_report(got.groupBy("status").count(), ["status"]).startswith("| status | count |")


def test_annotation_loop(spark):
    clips = spark.createDataFrame([("c1", "ok"), ("c2", "cut"), ("c3", "none")], "clip_id string, prompt string")

    def client(prompt):
        return {"ok": '```json\n[{"a": 1}, {"a": 2}]\n```', "cut": '[{"a": 3}, {"a":', "none": 'sorry [oops {"a": 4}'}[prompt]

    events, errors = evaluation.annotate(clips, client)
    assert sorted((r.clip_id, r.item) for r in events.collect()) == [("c1", '{"a": 1}'), ("c1", '{"a": 2}'), ("c2", '{"a": 3}')]
    assert [r.clip_id for r in errors.collect()] == ["c3"]
    assert [json.loads(r.item)["a"] for r in evaluation.reprocess(errors).collect()] == [4]
