"""Queries of release checks, gates, reports, exports and prompts, each with a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans import release
from tidewright.plans.event_queries import EV, GAMES, games, roster
from tidewright.session import table

PLAYERS = ("Gemini", "baile", "saoyi")
LAYERS = ("perception_access", "knowledge_state", "belief_and_false_belief")


def _k() -> Column:
    return F.col("k")


def _pick(*values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (_k() % len(values) + 1).cast("int"))


def _names() -> Column:
    return F.array(*[F.lit(p) for p in PLAYERS])


def _counted(issues: DataFrame) -> DataFrame:
    return issues.groupBy("check", "code").agg(F.count("*").alias("n_issues"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def config_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game's configuration, made of its events: ranges, exclusions and players that turn on their number."""
    ev = games(spark, sf_dir)
    conf = ev.groupBy("game_id").agg(F.min("s").alias("lo"), F.max("e").alias("hi")).select(
        "game_id", F.when(F.col("game_id") % 5 == 0, F.lit(-1.0)).otherwise(F.col("lo")).alias("valid_start"), F.when(F.col("game_id") % 3 == 0, F.lit(None).cast("double")).when(F.col("game_id") % 7 == 0, F.col("lo")).otherwise(F.col("hi")).alias("valid_end"),
        F.array(F.struct((F.col("lo") + 1).alias("start"), F.when(F.col("game_id") % 4 == 0, F.col("lo")).otherwise(F.col("hi") + F.col("game_id") % 2).alias("end"))).alias("excluded"),
    )
    players = roster(ev).where("player_id % 11 <> 0")
    players = players.unionByName(players.where("player_id % 13 = 0"))
    return _counted(release.config_issues(conf.unionByName(conf.where("game_id % 10 = 1")), players, {"pipeline": "strict_tom_pilot", "version": "a", "required_version": "b", "dual_pass": True, "max_visual_chunk_sec": 0, "split_on_phase_boundaries": False}))


def pilot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    trials = ev.select(F.format_string("t%08d", "event_id").alias("trial_id"), _pick(*LAYERS[:2]).alias("layer"), F.col("user_id").alias("target_player"), F.array(F.concat(F.lit("e"), _k())).alias("evidence_ids")).where("target_player % 3 > 0")
    nodes = ev.where("k % 2 = 0").select(F.array(F.concat(F.lit("e"), _k())).alias("evidence_asset_ids"))
    return _counted(release.pilot(ev.where("event_type = 'none'"), nodes, trials, roster(ev), LAYERS))


def completion_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    trials = ev.select((F.col("game_id") * 2).alias("segment_id"), (F.col("event_id") - F.when(_k() % 9 == 0, 1).otherwise(0)).alias("trial_id"))
    segments = ev.select((F.col("game_id") * 3).alias("segment_id")).distinct()
    return _counted(release.trial_completion(trials, segments))


def weak_benchmark_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    trials = ev.select(F.format_string("t%d", F.floor(F.col("event_id") / 2)).alias("trial_id"), _pick("single_pov_video", "single_pov_events", "text_only", "odd", None).alias("input_condition"))
    return _counted(release.weak_benchmark(trials, ev.where("k > 3"), ev.where("k % 5 = 0")))


def flat_view_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    clips = ev.where("k % 10 > 0").select(F.format_string("c%d", "event_id").alias("clip_id"), F.when(_k() % 6 == 0, "other").otherwise("g").alias("game_id"), F.col("user_id").alias("player_id"), F.col("s").alias("start_sec"), F.col("e").alias("end_sec"))
    rows = ev.select(F.format_string("e%08d", "event_id").alias("event_id"), F.format_string("c%d", "event_id").alias("clip_id"), F.lit("g").alias("game_id"), (F.col("user_id") + F.when(_k() % 8 == 0, 1).otherwise(0)).alias("player_id"), (F.col("s") - F.when(_k() % 7 == 0, 1).otherwise(0)).alias("start_sec"), (F.col("e") + F.when(_k() % 5 == 0, 1).otherwise(0)).alias("end_sec"))
    return _counted(release.flat_views(rows, clips, "g"))


def gold_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    obs = F.struct(F.when(_k() % 4 == 0, F.array(F.lit("speech_claim"))).when(_k() % 4 == 1, F.array(F.lit("odd"))).alias("source_types"), _pick("public", "odd", "pov_visible").alias("visibility"))
    asked = F.struct(_pick("low", "high", "odd").alias("risk_of_perspective_leakage"), (_k() % 2 == 0).alias("needs_human_review"))
    rows = ev.select(
        F.format_string("a%08d", "event_id").alias("annotation_file"), _pick("gameplay", "meeting", "final").alias("phase_type"), F.when(_k() % 5 > 0, F.array(obs)).otherwise(F.array().cast("array<struct<source_types:array<string>,visibility:string>>")).alias("observations"), F.when(_k() % 7 > 0, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("utterances"),
        F.when(_k() % 6 > 0, F.array(asked)).otherwise(F.array().cast("array<struct<risk_of_perspective_leakage:string,needs_human_review:boolean>>")).alias("tom_questions"), F.when(_k() % 8 == 0, 1).alias("gameplay_round_index"), F.when(_k() % 9 == 0, 1).alias("meeting_round_index"),
    )
    return _counted(release.gold_rows(rows))


def envelope_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    place = F.format_string("a%08d", "event_id")
    inner = F.struct(F.when(_k() % 6 > 0, F.col("s")).alias("aligned_start_sec"), (F.col("e") - F.when(_k() % 5 == 0, 1.0).otherwise(0.0)).alias("aligned_end_sec"), (F.col("e") - F.col("s")).alias("duration_sec"))
    item = F.struct(F.when(_k() % 4 > 0, place).alias("annotation_file"), F.lit("p").alias("player_id"), F.when(_k() % 3 == 0, "q").otherwise("ph").alias("phase_id"), inner.alias("time"), F.col("s").alias("aligned_start_sec"), (F.col("e") - F.when(_k() % 5 == 0, 1.0).otherwise(0.0)).alias("aligned_end_sec"), (F.col("e") - F.col("s") + F.when(_k() % 7 == 0, 1.0).otherwise(0.0)).alias("duration_sec"), _pick("gameplay", "meeting").alias("phase_type"), F.when(_k() % 8 > 0, F.array(F.lit(1))).alias("gameplay_trace"), F.when(_k() % 9 > 0, F.array(F.lit(1))).alias("utterances"))
    rows = ev.select(place.alias("annotation_file"), F.lit("p").alias("player_id"), F.lit("ph").alias("phase_id"), F.parse_json(F.to_json(item)).alias("item"))
    return _counted(release.envelopes(rows, ("annotation_file", "phase_id", "phase_type")))


def review_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate over one set of records whose fields turn on `k`."""
    ev = games(spark, sf_dir)
    rows = ev.select(
        "event_id", F.when(_k() % 10 > 0, "g").alias("probe_group_id"), _pick("accept_human_verified", "accept_human_verified", "reject").alias("gate_decision"), (_k() % 4 > 0).alias("reviewer_trusted"), F.when(_k() % 5 > 0, F.array(F.lit("e"))).alias("evidence_checked"), F.when(_k() % 6 == 0, F.array(F.lit("u"))).alias("remaining_uncertainties"), (_k() % 7 == 0).alias("needs_human_review_after"),
        _pick("accept", "reject").alias("merge_decision"), (_k() % 3 == 0).alias("safe_for_drafts"), _pick("exact", "minor_correction", None).alias("transcript_match"), _pick("high", "low").alias("text_confidence"), _pick("high", "high", "medium", None).alias("speaker_confidence"), _pick("baile", "unknown", "odd", None).alias("canonical_speaker"),
        F.when(_k() % 4 == 0, F.array(F.lit("baile"))).when(_k() % 4 == 1, F.array(F.lit("who"))).alias("claim_target_players"), F.when(_k() % 2 == 0, F.array(F.lit("use"))).alias("suggested_probe_uses"), (_k() % 8 > 0).alias("needs_human_review"), _pick("high", "medium", "low").alias("tom_relevance"), (_k() % 9 > 0).alias("parse_ok"), _pick("confirm_candidate", "odd", "reject").alias("decision"), (_k() % 11 == 0).alias("eligible_for_merge"), _pick("high", "medium", "low").alias("evidence_quality"),
    )
    j = lambda c: F.array_join(c, ",")
    g, s, c, a = release.review_gate(), release.scope_gate(), release.claim_audit(_names()), release.audio_audit(_names())
    return rows.select("event_id", g["ok"].alias("gate_ok"), j(g["reasons"]).alias("gate_reasons"), j(s["reasons"]).alias("scope_reasons"), release.merge_decision(_names()).alias("merge_review"), j(c["issues"]).alias("claim_issues"), c["priority"].alias("priority"), j(a["issues"]).alias("audio_issues"), a["may_merge"].alias("may_merge"))


def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = games(spark, sf_dir).select(_pick("accept", "reject", "", None).alias("decision"), F.col("event_type").alias("claim_type"), (_k() % 3 == 0).alias("parse_ok"), _pick("x", "y").alias("quality"))
    return release.field_report(rows, ["decision", "claim_type", "quality"], {"parse_ok": F.col("parse_ok"), "needs_audio": F.col("decision").isin("accept") & (F.col("quality") == "x")})


def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir).select("event_type", (_k() % 2 == 0).alias("q1_correct"), F.when(_k() % 3 > 0, "ref").alias("q2_reference"), F.when(_k() % 5 > 0, (_k() % 4) * 25).alias("q2_score"))
    return release.judge_mean(ev, ["event_type"], "q1_correct", "q2_reference", "q2_score").select("event_type", "n", F.round("mean", 6).alias("mean"))


def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language guesses by source against the documents' languages, labelled documents being the gold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    guess = F.when(F.col("doc_id") % 4 == 0, "en").when(F.col("doc_id") % 4 == 1, F.col("lang"))
    preds = docs.select(F.col("doc_id").alias("trial_id"), guess.alias("prediction"), (F.col("doc_id") % 5 == 0).alias("used_forbidden"), (F.col("doc_id") % 3 > 0).alias("parse_ok"), F.when(F.col("doc_id") % 2 == 0, True).alias("schema_ok"))
    gold = labels.join(docs, "doc_id").select(F.col("doc_id").alias("trial_id"), F.col("lang").alias("label"))
    out = release.label_accuracy(preds, gold)
    return out.select("total", "forbidden_count", *[F.round(c, 6).alias(c) for c in ("label_accuracy", "leakage_rate", "parse_rate", "schema_rate")])


def letter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    item = F.parse_json(F.to_json(F.struct(F.when(_k() % 2 == 0, _k()).alias("processed"), F.lit("7").alias("total"), F.when(_k() % 3 == 0, "id9").alias("next_pending_id"))))
    p = release.progress(item)
    return ev.select("event_id", release.letter_score(_pick("A", "B", ""), _pick(" a ", "b", "C", None)).alias("right"), p["processed"].alias("processed"), p["total"].alias("total"), p["correct"].alias("correct"), p["next_pending_id"].alias("next_pending_id"))


def _export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = games(spark, sf_dir)
    trials = ev.select(F.format_string("t%d", "event_id").alias("trial_id"), F.col("user_id").alias("target_player_id"), F.array(F.format_string("ge%d", F.col("event_id") * 2), F.format_string("ge%d", "event_id")).alias("supporting_global_event_ids"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    events = ev.where("k % 10 > 0").select(F.format_string("ge%d", "event_id").alias("global_event_id"), "game_id", F.col("s").alias("start_sec"), F.col("e").alias("end_sec"), F.array(F.col("user_id") + 1, F.col("user_id")).alias("source_player_ids"))
    offsets = roster(ev).where("player_id % 4 > 0").select("game_id", "player_id", (F.col("player_id") * 10.0).alias("raw_start_sec"))
    return release.aligned_export(trials, events, offsets), trials


def aligned_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _export(spark, sf_dir)[0].select("trial_id", "global_event_id", "player_id", "aligned_start_sec", "aligned_end_sec", "raw_start_sec", "raw_end_sec", "event_timestamp", "skipped")


def two_step_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported, trials = _export(spark, sf_dir)
    out = release.two_step_questions(exported, trials)
    return out.select("video_id", F.col("question_1.timestamp").alias("marked_at"), F.col("question_1.correct_answer").alias("correct_answer"), F.col("question_2.answer").alias("answer"))


def source_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    item = F.parse_json(F.to_json(F.struct(_pick("said", "unknown", None).alias("speech_claim"), F.when(_k() % 4 == 0, True).when(_k() % 4 == 1, False).alias("public_result"), _pick("无", "thinks", " ", None, "none").alias("inferred_belief"))))
    said = _pick("看见 task", "他的发言", "投票 结果", "认为", "hello", "视频 transcript")
    types, asked = release.source_types(), release.question_sources(said)
    return ev.select("event_id", item.alias("item")).join(ev.select("event_id", "k"), "event_id").select("event_id", F.array_join(types, ",").alias("types"), release.visibility_of(types).alias("visibility"), F.array_join(asked, ",").alias("question_sources"), release.answerable(asked).alias("answerable"))


def prompt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by letter, their safety, and A prompts rebuilt round their context."""
    ev = games(spark, sf_dir)
    prompts = F.array(F.struct(_pick("A", "", None).alias("prompt_id"), F.lit("B_post_reveal_reconstruct_previous_belief").alias("probe_type"), F.lit("one").alias("prompt")), F.struct(_pick("D", "odd").alias("prompt_id"), F.lit("").alias("probe_type"), F.lit("two").alias("prompt")))
    probe = _pick("A_pre_reveal_belief", "D_perspective_taking_prediction", "C_other_agent_false_belief")
    body = F.concat(_pick("QUERY_VARIABLE_PUBLIC_FORM_JSON ", "x "), _pick("TARGET_LISTENER_CONTEXT_JSON ", "hidden_event_ids ", "", ""), F.lit("TARGET_AVAILABLE_CONTEXT_JSON: ctx"), _k(), F.lit(" QUESTION: why"))
    got = release.prompt_texts(prompts)
    rebuilt = release.repaired_a(F.when(_k() % 2 == 0, body).otherwise("none"), F.lit("H"), F.lit("{q}"), F.lit("baile"))
    names = F.array_sort(F.map_keys(release.answer_schema(probe)))
    return ev.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(got)), lambda x: F.concat_ws(":", x["key"], x["value"])), ",").alias("texts"), release.prompt_is_safe(probe, body).alias("safe"), rebuilt.alias("rebuilt"), F.array_join(names, ",").alias("answer_fields"))


def prompt_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    raw = F.when(_k() % 4 == 0, '{"state": "in_game", "reason": "r"}').when(_k() % 4 == 1, "I see In Game now").when(_k() % 4 == 2, '{"state": "StartScreen"}').otherwise("lobby")
    state = release.frame_state(raw)
    prompt = F.when(_k() % 3 == 0, F.concat(F.lit("x aligned_time=[ "), F.col("s").cast("bigint"), F.lit(", "), (F.col("s") + 0.5).cast("string"), F.lit("] y"))).otherwise("none")
    w = release.aligned_window(prompt)
    rows = ev.select("event_id", "k", "s", F.lit("q").alias("query_type"), F.lit(None).cast("string").alias("proposition"), F.col("user_id").alias("target_player"), F.col("e").alias("cutoff_abs_sec"), F.array(F.lit("c")).alias("related_claim_ids"), F.array().cast("array<string>").alias("available_evidence_ids_for_target"))
    q = release.public_query()
    return rows.select("event_id", state["state"].alias("state"), state["reason"].alias("reason"), w["start_sec"].alias("start_sec"), w["end_sec"].alias("end_sec"), F.get_json_object(q, "$.query_type").alias("query_type"), F.get_json_object(q, "$.proposition").alias("proposition"), F.get_json_object(q, "$.related_claim_ids[0]").alias("claim"))


def repaired_d_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    groups = ev.where("event_type = 'signup'").select(F.col("event_id").alias("probe_group_id"), "game_id", F.col("user_id").alias("target_player"), F.col("e").alias("cutoff_abs_sec"), F.array(F.concat(F.lit("c"), _k() % 5), F.lit("c9")).alias("related_claim_ids"))
    claims = spark.createDataFrame([(f"c{i}", ["Gemini", "odd", "baile"][i % 3], f"said {i}") for i in range(4)], "claim_id string, speaker string, content string")
    one = F.array(F.format_string("h%d", "event_id"))
    snaps = ev.where("event_type = 'error'").select("game_id", F.col("user_id").cast("string").alias("target_player"), F.col("e").alias("cutoff_abs_sec"), one.alias("public_history"), one.alias("private_observations"), one.alias("heard_claims"))
    return release.repaired_d(groups, claims, snaps, _names()).select("probe_group_id", "speaker", "prompt")


def refined_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir).withColumn("state", _pick("start_screen", "other", "in_game"))
    return release.refine_bounds(ev, ["user_id"], "s", "state")


QUERIES = {f.__name__: f for f in (
    config_issues, pilot_issues, completion_issues, weak_benchmark_issues, flat_view_issues, gold_issues, envelope_issues, review_gates, review_report, judge_means, label_accuracy, letter_scores, aligned_export, two_step_questions,
    source_projections, prompt_rules, prompt_scalars, repaired_d_prompts, refined_bounds,
)}

_G = f"WITH {EV}, {GAMES}"
_N = ' SELECT "check", code, count(*) AS n_issues, min(key) AS first_key, max(key) AS last_key FROM i GROUP BY ALL'


def _issues(check: str, *parts: tuple[str, str, str, str]) -> str:
    """Rows of (code, key, source, condition) as CTE `i`."""
    return ", i AS (" + " UNION ALL ".join(f"""SELECT '{check}' AS "check", '{code}' AS code, CAST({key} AS VARCHAR) AS key FROM {source} WHERE {cond}""" for code, key, source, cond in parts) + ")" + _N


ORACLE_SQL = {
    "config_issues": _G + """, c0 AS (SELECT game_id, min(s) AS lo, max(e) AS hi FROM gv GROUP BY game_id), c1 AS (SELECT game_id, CASE WHEN game_id % 5 = 0 THEN -1.0 ELSE lo END AS vs, CASE WHEN game_id % 3 = 0 THEN NULL WHEN game_id % 7 = 0 THEN lo ELSE hi END AS ve, lo + 1 AS xs, CASE WHEN game_id % 4 = 0 THEN lo ELSE hi + game_id % 2 END AS xe FROM c0),
        c AS (SELECT * FROM c1 UNION ALL SELECT * FROM c1 WHERE game_id % 10 = 1), p AS (SELECT game_id, player_id FROM roster WHERE player_id % 11 <> 0), d AS (SELECT game_id FROM c GROUP BY game_id HAVING count(*) > 1), one AS (SELECT 'settings' AS game_id)"""
        + _issues("config", ("duplicate_game_id", "game_id", "d", "true"), ("duplicate_player_id", "game_id || '|' || player_id", "p", "player_id % 13 = 0"), ("game_without_players", "game_id", "c", "game_id NOT IN (SELECT game_id FROM p)"), ("invalid_valid_range", "game_id", "c", "vs < 0 OR ve <= vs"), ("invalid_excluded_range", "game_id", "c", "xs < vs OR xe <= xs"), ("excluded_exceeds_valid_range", "game_id", "c", "xe > ve"),
                  ("strict_version", "game_id", "one", "true"), ("strict_visual_chunk", "game_id", "one", "true"), ("strict_phase_split", "game_id", "one", "true")),
    "pilot_issues": _G + """, t AS (SELECT printf('t%08d', event_id) AS tid, k, user_id, k % 2 AS l FROM gv WHERE user_id % 3 > 0), l AS (SELECT unnest(['perception_access', 'knowledge_state', 'belief_and_false_belief']) AS layer, unnest([0, 1, 2]) AS n), lc AS (SELECT layer, (SELECT count(*) FROM t WHERE t.l = l.n) AS c FROM l), one AS (SELECT 'episodes' AS game_id)"""
        + _issues("pilot", ("missing_trial_evidence", "tid", "t", "k NOT IN (SELECT k FROM gv WHERE k % 2 = 0)"), ("thin_layer", "layer", "lc", "c < 30"), ("never_a_target", "player_id", "(SELECT DISTINCT player_id FROM roster) r", "player_id NOT IN (SELECT user_id FROM t)"), ("few_episodes", "game_id", "one", "true")),
    "completion_issues": _G + """, t AS (SELECT game_id * 2 AS seg, event_id - CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS tid FROM gv), sg AS (SELECT DISTINCT game_id * 3 AS seg FROM gv), d AS (SELECT seg || '::' || tid AS kk FROM t GROUP BY seg, tid HAVING count(*) > 1)"""
        + _issues("completion", ("candidate_trial_unknown_segment", "tid", "t", "seg NOT IN (SELECT seg FROM sg)"), ("duplicate_candidate_trial_id", "kk", "d", "true"), ("missing_candidate_trials_for_segment", "seg", "sg", "seg NOT IN (SELECT seg FROM t)")),
    "weak_benchmark_issues": _G + """, t AS (SELECT 't' || (event_id // 2) AS tid, ['single_pov_video', 'single_pov_events', 'text_only', 'odd', NULL][k % 5 + 1] AS cond FROM gv), n AS (SELECT (SELECT count(*) FROM gv WHERE k % 5 = 0) AS want, (SELECT count(*) FROM t) AS have, (SELECT count(*) FROM gv WHERE k > 3) AS gold),
        c AS (SELECT unnest(['single_pov_video', 'single_pov_events', 'multi_pov_global', 'multi_pov_perspective', 'text_only']) AS cond), cc AS (SELECT cond, (SELECT count(*) FROM t WHERE t.cond = c.cond) AS have, (SELECT want FROM n) AS want FROM c), d AS (SELECT tid FROM t GROUP BY tid HAVING count(*) > 1)"""
        + _issues("weak_benchmark", ("benchmark_trial_count_mismatch", "'trials'", "n", "have <> want * 5"), ("gold_count_mismatch", "NULL", "n", "have <> gold"), ("duplicate_benchmark_trial_id", "tid", "d", "true"), ("invalid_input_condition", "tid", "t", "cond IS NULL OR cond = 'odd'"), ("condition_count_mismatch", "cond", "cc", "have <> want")),
    "flat_view_issues": _G + ", z AS (SELECT 'c' || event_id AS c, printf('e%08d', event_id) AS ev, k FROM gv)"
        + _issues("flat_pov", ("annotation_game_id_mismatch", "c", "z", "k % 10 > 0 AND k % 6 = 0"), ("unknown_clip", "ev", "z", "k % 10 = 0"), ("identity_mismatch", "ev", "z", "k % 10 > 0 AND (k % 6 = 0 OR k % 8 = 0)"), ("outside_clip", "ev", "z", "k % 10 > 0 AND (k % 7 = 0 OR k % 5 = 0)")),
    "gold_issues": _G + ", z AS (SELECT printf('a%08d', event_id) AS f, k FROM gv)"
        + _issues("gold", ("gameplay_missing_round_index", "f", "z", "k % 3 = 0 AND k % 8 <> 0"), ("meeting_missing_round_index", "f", "z", "k % 3 = 1 AND k % 9 <> 0"), ("final_has_round_index", "f", "z", "k % 3 = 2 AND (k % 8 = 0 OR k % 9 = 0)"), ("gameplay_empty_observations", "f", "z", "k % 3 = 0 AND k % 5 = 0"), ("meeting_empty_utterances", "f", "z", "k % 3 = 1 AND k % 7 = 0"), ("empty_tom_questions", "f", "z", "k % 6 = 0"),
                  ("bad_observation_source_types", "f", "z", "k % 5 > 0 AND k % 4 <> 0"), ("bad_observation_visibility", "f", "z", "k % 5 > 0 AND k % 3 = 1"), ("bad_leakage_risk", "f", "z", "k % 6 > 0 AND k % 3 = 2"), ("leakage_not_reviewed", "f", "z", "k % 6 > 0 AND k % 3 = 1 AND k % 2 = 1")),
    "envelope_issues": _G + ", z AS (SELECT printf('a%08d', event_id) AS f, k FROM gv)"
        + _issues("envelope", ("missing_required_annotation_fields", "f", "z", "k % 4 = 0"), ("annotation_file_mismatch", "f", "z", "k % 4 = 0"), ("phase_id_mismatch", "f", "z", "k % 3 = 0"), ("invalid_time_values", "f", "z", "k % 6 = 0"), ("invalid_time_range", "f", "z", "k % 6 > 0 AND k % 5 = 0"), ("top_level_time_mismatch", "f", "z", "k % 7 = 0"), ("gameplay_missing_trace", "f", "z", "k % 8 = 0"), ("meeting_missing_utterances", "f", "z", "k % 2 = 1 AND k % 9 = 0")),
    "review_gates": _G + """, z AS (SELECT event_id, k, k % 4 = 0 AS known, k % 4 < 2 AS sp FROM gv),
        r AS (SELECT *, list_filter([CASE WHEN k % 10 = 0 THEN 'missing_probe_group_id' END, CASE WHEN k % 3 = 2 THEN 'decision_not_accept' END, CASE WHEN k % 4 = 0 THEN 'reviewer_not_trusted' END, CASE WHEN k % 5 = 0 THEN 'missing_evidence_checked' END, CASE WHEN k % 6 = 0 THEN 'remaining_uncertainties_nonempty' END, CASE WHEN k % 7 = 0 THEN 'still_needs_human_review' END], lambda x: x IS NOT NULL) AS g,
            list_filter([CASE WHEN k % 2 = 1 THEN 'not_merge_candidate' END, CASE WHEN k % 3 > 0 THEN 'not_safe_for_drafts' END, CASE WHEN k % 3 > 0 THEN 'transcript_not_exact' END, CASE WHEN k % 2 = 1 THEN 'text_confidence_not_high' END, CASE WHEN k % 4 > 1 THEN 'speaker_confidence_not_high' END], lambda x: x IS NOT NULL) AS s,
            list_filter([CASE WHEN k % 4 = 1 THEN 'invalid_claim_target_players' END, CASE WHEN k % 8 = 0 THEN 'needs_human_review_not_true' END, CASE WHEN k % 4 > 1 THEN 'invalid_canonical_speaker' END], lambda x: x IS NOT NULL) AS c,
            list_filter([CASE WHEN k % 9 = 0 THEN 'parse_not_ok' END, CASE WHEN k % 3 = 1 THEN 'invalid_decision' END, CASE WHEN k % 11 = 0 THEN 'claims_direct_eligibility' END, CASE WHEN k % 8 = 0 THEN 'needs_human_review_not_true' END, CASE WHEN k % 4 > 1 THEN 'invalid_canonical_speaker' END, CASE WHEN k % 4 = 1 THEN 'invalid_claim_target_players' END], lambda x: x IS NOT NULL) AS a FROM z)
        SELECT event_id, len(g) = 0 AS gate_ok, array_to_string(g, ',') AS gate_reasons, array_to_string(s, ',') AS scope_reasons, CASE WHEN k % 3 = 0 AND k % 2 = 0 AND k % 4 = 0 THEN 'accept' ELSE 'reject' END AS merge_review, array_to_string(c, ',') AS claim_issues, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'high' WHEN k % 3 < 2 THEN 'medium' ELSE 'low' END AS priority,
            array_to_string(a, ',') AS audio_issues, len(a) = 0 AND k % 3 = 0 AND k % 4 = 0 AS may_merge FROM r""",
    "review_report": _G + """, z AS (SELECT CASE WHEN k % 4 = 0 THEN 'accept' WHEN k % 4 = 1 THEN 'reject' ELSE 'unknown' END AS d, event_type AS c, CASE WHEN k % 2 = 0 THEN 'x' ELSE 'y' END AS q, k FROM gv)
        SELECT 'decision' AS field, d AS value, count(*) AS n FROM z GROUP BY d UNION ALL SELECT 'claim_type', c, count(*) FROM z GROUP BY c UNION ALL SELECT 'quality', q, count(*) FROM z GROUP BY q UNION ALL SELECT '(flag)', 'parse_ok', count(*) FILTER (k % 3 = 0) FROM z UNION ALL SELECT '(flag)', 'needs_audio', count(*) FILTER (k % 4 = 0) FROM z UNION ALL SELECT '(flag)', 'rows', count(*) FROM z""",
    "judge_means": _G + " SELECT event_type, count(*) FILTER (k % 2 = 0 AND k % 3 > 0 AND k % 5 > 0) AS n, round(coalesce(avg((k % 4) * 25.0) FILTER (k % 2 = 0 AND k % 3 > 0 AND k % 5 > 0), 0.0), 6) AS mean FROM gv GROUP BY event_type",
    "label_accuracy": """WITH g AS (SELECT doc_id, lang FROM labels JOIN documents USING (doc_id)), p AS (SELECT d.doc_id, CASE d.doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN d.lang END AS pr, g.lang AS label FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id)
        SELECT count(*) AS total, count(*) FILTER (doc_id % 5 = 0) AS forbidden_count, round(avg(CAST(pr IS NOT DISTINCT FROM label AS INT)), 6) AS label_accuracy, round(avg(CAST(doc_id % 5 = 0 AS INT)), 6) AS leakage_rate, round(avg(CAST(doc_id % 3 > 0 AS INT)), 6) AS parse_rate, round(avg(CAST(doc_id % 2 = 0 AS INT)), 6) AS schema_rate FROM p""",
    "letter_scores": _G + " SELECT event_id, coalesce(['A', 'B', ''][k % 3 + 1] = ['A', 'B', 'C', NULL][k % 4 + 1], false) AS right, CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS processed, 7 AS total, 0 AS correct, CASE WHEN k % 3 = 0 THEN 'id9' ELSE '-' END AS next_pending_id FROM gv",
    "aligned_export": _G + """, ok AS (SELECT * FROM gv WHERE k % 10 > 0), x AS (SELECT t.event_id AS tid, t.user_id AS target, coalesce(a.event_id, b.event_id) AS ge FROM gv t LEFT JOIN ok a ON a.event_id = t.event_id * 2 LEFT JOIN ok b ON b.event_id = t.event_id),
        y AS (SELECT tid, 'ge' || ge AS g, e.game_id, s, e.e, CASE WHEN target IN (e.user_id, e.user_id + 1) THEN target WHEN ge IS NOT NULL THEN e.user_id + 1 END AS p FROM x LEFT JOIN gv e ON e.event_id = ge),
        w AS (SELECT y.*, r.player_id * 10.0 AS o, greatest(greatest(0.0, s - 8), e + 8 - 60) AS a, e + 8 AS b FROM y LEFT JOIN roster r ON r.game_id = y.game_id AND r.player_id = p AND p % 4 > 0)
        SELECT 't' || tid AS trial_id, g AS global_event_id, p AS player_id, CASE WHEN g IS NOT NULL THEN a END AS aligned_start_sec, b AS aligned_end_sec, o + a AS raw_start_sec, o + b AS raw_end_sec, CASE WHEN g IS NOT NULL THEN greatest(0.0, s - a) END AS event_timestamp, CASE WHEN g IS NULL THEN 'no_event' WHEN o IS NULL THEN 'no_offset' END AS skipped FROM w""",
    "source_projections": _G + """, z AS (SELECT event_id, k, k % 3 = 0 AS sc, k % 4 = 0 AS pr, k % 5 = 1 AS ib FROM gv), y AS (SELECT *, ['direct_visual_observation', 'speech_claim', 'public_result', 'inferred_belief', 'direct_visual_observation', 'direct_visual_observation,speech_claim'][k % 6 + 1] AS qs FROM z)
        SELECT event_id, CASE WHEN sc OR pr OR ib THEN array_to_string(list_filter([CASE WHEN sc THEN 'speech_claim' END, CASE WHEN pr THEN 'public_result' END, CASE WHEN ib THEN 'inferred_belief' END], lambda x: x IS NOT NULL), ',') ELSE 'direct_visual_observation' END AS types,
            CASE WHEN ib THEN 'inferred' WHEN sc THEN 'heard_speech' WHEN pr THEN 'public' ELSE 'pov_visible' END AS visibility, qs AS question_sources, ['video_only', 'audio_only', 'video_only', 'not_answerable_without_gold', 'video_only', 'video_audio'][k % 6 + 1] AS answerable FROM y""",
    "prompt_rules": _G + """ SELECT event_id, array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'A:one' END, CASE WHEN k % 3 > 0 THEN 'B:one' END, CASE WHEN k % 2 = 0 THEN 'D:two' END], lambda x: x IS NOT NULL), ',') AS texts, CASE k % 3 WHEN 0 THEN k % 2 = 0 AND k % 4 <> 1 WHEN 1 THEN k % 4 <> 0 ELSE true END AS safe,
        'H' || chr(10) || 'QUERY_VARIABLE_PUBLIC_FORM_JSON:' || chr(10) || '{q}' || chr(10) || 'TARGET_AVAILABLE_CONTEXT_JSON:' || chr(10) || CASE WHEN k % 2 = 0 THEN 'ctx' || k ELSE '{}' END || chr(10) || 'QUESTION: From the view of baile at cutoff, answer the public query above. Return strict JSON matching the schema.' AS rebuilt,
        ['belief_label,confidence,evidence_ids,knows_truth,likely_belief,suspicion_update', 'confidence,listener,predicted_listener_next_action,predicted_listener_trust_update,reason_from_speaker_perspective,speaker', 'confidence,evidence_ids_available_to_other_player,other_player,other_player_knew_truth_at_cutoff,other_player_likely_belief'][k % 3 + 1] AS answer_fields FROM gv""",
    "prompt_scalars": _G + """ SELECT event_id, ['in_game', 'in_game', 'start_screen', 'other'][k % 4 + 1] AS state, CASE WHEN k % 4 = 0 THEN 'r' ELSE '' END AS reason, CASE WHEN k % 3 = 0 THEN s END AS start_sec, CASE WHEN k % 3 = 0 THEN s + 0.5 END AS end_sec, 'q' AS query_type, '' AS proposition, 'c' AS claim FROM gv""",
    "repaired_d_prompts": _G + """, g AS (SELECT * FROM gv WHERE event_type = 'signup'), sn AS (SELECT game_id, user_id, e, min(event_id) AS ev FROM gv WHERE event_type = 'error' GROUP BY ALL),
        x AS (SELECT g.event_id, k % 5 AS c, CASE k % 5 WHEN 0 THEN 'Gemini' WHEN 2 THEN 'baile' WHEN 3 THEN 'Gemini' ELSE 'unknown' END AS sp, (SELECT arg_max(ev, sn.e) FROM sn WHERE sn.game_id = g.game_id AND sn.user_id = g.user_id AND sn.e <= g.e + 1e-6) AS h FROM g)
        SELECT event_id AS probe_group_id, sp AS speaker, 'RELATED_CLAIMS_JSON:' || chr(10) || CASE WHEN c < 4 THEN '[{"claim_id":"c' || c || '","content":"said ' || c || '"}]' ELSE '[]' END || chr(10) || 'SPEAKER_AVAILABLE_CONTEXT_JSON:' || chr(10) || '{}' || chr(10) || 'SPEAKER_MODEL_OF_LISTENER_PUBLIC_HISTORY_JSON:' || chr(10)
            || CASE WHEN h IS NULL THEN '{}' ELSE '{"public_history":["h' || h || '"],"heard_claims":["h' || h || '"]}' END || chr(10) || 'QUESTION: From the view of ' || sp || ', predict how the listener takes the claim.' AS prompt FROM x""",
    "refined_bounds": _G + """, a AS (SELECT user_id, min(s) FILTER (k % 3 = 2) AS after_at FROM gv GROUP BY user_id) SELECT user_id, max(s) FILTER (k % 3 = 0 AND s < after_at) AS before_at, any_value(after_at) AS after_at FROM gv JOIN a USING (user_id) GROUP BY user_id""",
}
ORACLE_SQL["two_step_questions"] = "WITH z AS (" + ORACLE_SQL["aligned_export"] + ") SELECT trial_id || '_' || global_event_id || '_' || player_id AS video_id, printf('%.3f', event_timestamp) AS marked_at, 'A' AS correct_answer, 'a' AS answer FROM z WHERE skipped IS NULL"

#: Columns whose literals DuckDB would take for narrower types.
for _name, _types in {
    "letter_scores": {"total": "BIGINT", "correct": "BIGINT"},
}.items():
    _casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _types.items())
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE_SQL[_name]}) AS q"
