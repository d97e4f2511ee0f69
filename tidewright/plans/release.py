"""Checks, gates, reports and exports around a release: all as issue tables, reason-coded structs, or counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import numbers, payload, text
from tidewright.operators import aggregates, joins, windows
from tidewright.plans import checks

# Enumerations of release rows, marks of question sources, and what each probe must answer with.
CONDITIONS = ("single_pov_video", "single_pov_events", "multi_pov_global", "multi_pov_perspective", "text_only")
SOURCE_TYPES = ("direct_visual_observation", "speech_claim", "public_result", "inferred_belief", "hidden_or_not_visible_information")
VISIBILITY = ("pov_visible", "heard_speech", "public", "inferred", "hidden")
RISKS = ("low", "medium", "high", "unknown")
MEANINGLESS = ("", "unknown", "未知", "无", "none", "None")
SOURCE_MARKS = (
    ("direct_visual_observation", ("看见", "视觉", "视频", "visible", "movement", "task", "location", "尸体", "击杀")),
    ("speech_claim", ("发言", "声称", "claim", "transcript", "说")),
    ("public_result", ("投票", "结果", "public", "放逐", "胜利")),
    ("inferred_belief", ("认为", "怀疑", "belief", "推断")),
)
AUDIO_DECISIONS = ("confirm_candidate", "correct_transcript", "correct_speaker_or_alias", "reject", "uncertain")
PROMOTABLE = ("confirm_candidate", "correct_transcript", "correct_speaker_or_alias")
LEAK_MARKS = ("ORACLE_TRUTH_JSON", "hidden_event_ids", "forbidden_event_ids")
PROMPT_NAMES = {"A": ("A", "A_pre_reveal_belief"), "B": ("B", "B_post_reveal_reconstruct_previous_belief"), "C": ("C", "C_other_agent_false_belief"), "D": ("D", "D_perspective_taking_prediction")}
ANSWER_KEYS = {
    "A_pre_reveal_belief": {
        "knows_truth": "boolean",
        "belief_label": "believes_true|believes_false|uncertain|does_not_know|unknown",
        "likely_belief": "string",
        "suspicion_update": "increase|decrease|unchanged|unknown",
        "evidence_ids": "array[string]",
        "confidence": "number",
    },
    "B_post_reveal_reconstruct_previous_belief": {
        "target_knew_truth_at_cutoff": "boolean",
        "reconstructed_prior_belief": "string",
        "must_not_use_revealed_truth_as_prior_evidence": "boolean",
        "evidence_ids_available_at_cutoff": "array[string]",
        "confidence": "number",
    },
    "C_other_agent_false_belief": {
        "other_player": "string",
        "other_player_knew_truth_at_cutoff": "boolean",
        "other_player_likely_belief": "string",
        "evidence_ids_available_to_other_player": "array[string]",
        "confidence": "number",
    },
    "": {
        "speaker": "string",
        "listener": "string",
        "predicted_listener_trust_update": "increase|decrease|unchanged|unknown",
        "predicted_listener_next_action": "accuse|vote|defend|ignore|follow|avoid|unknown",
        "reason_from_speaker_perspective": "string",
        "confidence": "number",
    },
}
TASK_OF_QUERY = "Judge what the target player could know, verify, doubt, or remain uncertain about from target-available evidence only."
# End of fixed values.


def config_issues(games: DataFrame, players: DataFrame, settings: dict[str, object]) -> DataFrame:
    """Faults of a run's configuration. games: game_id, valid_start, valid_end (null: open), excluded (array of struct(start, end));
    players: game_id, player_id; settings: pipeline, version, dual_pass, max_visual_chunk_sec, ... of the strict pilot."""
    x = F.col("excluded")
    parts = [
        checks.duplicate_keys(games, "config", "game_id", "duplicate_game_id"),
        checks.duplicate_keys(players.withColumn("_k", F.concat_ws("|", "game_id", "player_id")), "config", "_k", "duplicate_player_id"),
        checks.missing_parent(games, "config", "game_id", players, "game_id", "game_id", "game_without_players"),
        checks.issues(games, "config", F.col("game_id"), [
            ("invalid_valid_range", (F.col("valid_start") < 0) | (F.col("valid_end") <= F.col("valid_start"))),
            ("invalid_excluded_range", F.exists(x, lambda r: (r["start"] < F.col("valid_start")) | (r["end"] <= r["start"]))), ("excluded_exceeds_valid_range", F.exists(x, lambda r: r["end"] > F.col("valid_end"))),
        ]),
    ]
    if settings.get("pipeline") == "strict_tom_pilot":
        wrong = {
            "strict_version": settings.get("version") != settings.get("required_version"), "strict_reference": settings.get("reference_player") != settings.get("required_reference"), "strict_dual_pass": not settings.get("dual_pass"),
            "strict_visual_chunk": float(settings.get("max_visual_chunk_sec", 30)) <= 0, "strict_audio_chunk": float(settings.get("max_audio_chunk_sec", 30)) <= 0, "strict_phase_split": not settings.get("split_on_phase_boundaries"),
        }
        parts.append(games.sparkSession.createDataFrame([("config", code, "settings", None) for code, bad in wrong.items() if bad], "check string, code string, key string, detail string"))
    return checks.report(parts)


def pilot(episodes: DataFrame, nodes: DataFrame, trials: DataFrame, players: DataFrame, layers: Sequence[str], least_episodes: int = 5, least_trials: int = 30) -> DataFrame:
    """Issues and coverage gaps of a pilot: evidence that no node has, few episodes, thin layers, players never a target.

    trials: trial_id, layer, target_player, evidence_ids."""
    used = trials.select("trial_id", F.explode("evidence_ids").alias("_e"))
    known = nodes.select(F.explode("evidence_asset_ids").alias("_e"))
    lost = checks.missing_parent(used, "pilot", "_e", known, "_e", "trial_id", "missing_trial_evidence")
    spark = trials.sparkSession
    wanted = spark.createDataFrame([(x,) for x in layers], "layer string").join(trials.groupBy("layer").agg(F.count("*").alias("_n")), "layer", "left")
    thin = checks.issues(wanted, "pilot", F.col("layer"), [("thin_layer", F.coalesce("_n", F.lit(0)) < least_trials)], F.coalesce("_n", F.lit(0)))
    targets = checks.coverage(trials.select(F.col("target_player").alias("player_id")), "pilot", players.select("player_id"), ["player_id"], "never_a_target")
    few = checks.issues(episodes.agg(F.count("*").alias("_n")), "pilot", F.lit("episodes"), [("few_episodes", F.col("_n") < least_episodes)], F.col("_n"))
    return checks.report([lost, thin, targets, few])


def trial_completion(trials: DataFrame, segments: DataFrame) -> DataFrame:
    """Candidate trials of unknown segments, doubled within one, and segments without any."""
    key = F.concat_ws("::", "segment_id", "trial_id")
    return checks.report([
        checks.missing_parent(trials, "completion", "segment_id", segments, "segment_id", "trial_id", "candidate_trial_unknown_segment"), checks.duplicate_keys(trials.withColumn("_k", key), "completion", "_k", "duplicate_candidate_trial_id"),
        checks.coverage(trials, "completion", segments, ["segment_id"], "missing_candidate_trials_for_segment"),
    ])


def weak_benchmark(trials: DataFrame, gold: DataFrame, candidates: DataFrame, conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """A trial for each candidate and input condition, as many gold rows, known conditions, ids once."""
    n = candidates.agg(F.count("*").alias("_want"))
    spark = trials.sparkSession
    by = spark.createDataFrame([(c,) for c in conditions], "input_condition string").join(trials.groupBy("input_condition").agg(F.count("*").alias("_n")), "input_condition", "left").crossJoin(F.broadcast(n))  # one row
    total = trials.agg(F.count("*").alias("_n")).crossJoin(n.select((F.col("_want") * len(conditions)).alias("_want")))
    return checks.report([
        checks.issues(total, "weak_benchmark", F.lit("trials"), [("benchmark_trial_count_mismatch", F.col("_n") != F.col("_want"))], F.col("_n")), checks.row_count(gold, "weak_benchmark", trials, "gold_count_mismatch"), checks.duplicate_keys(trials, "weak_benchmark", "trial_id", "duplicate_benchmark_trial_id"),
        checks.issues(trials, "weak_benchmark", F.col("trial_id"), [("invalid_input_condition", ~F.coalesce(F.col("input_condition").isin(*conditions), F.lit(False)))]),
        checks.issues(by, "weak_benchmark", F.col("input_condition"), [("condition_count_mismatch", F.coalesce("_n", F.lit(0)) != F.col("_want"))], F.coalesce("_n", F.lit(0))),
    ])


def flat_views(events: DataFrame, clips: DataFrame, game_id: str) -> DataFrame:
    """Clip events whose identity or time leaves their clip's envelope, and clips of another game. events: event_id, clip_id,
    game_id, player_id, start_sec, end_sec."""
    c = clips.select("clip_id", *[F.col(k).alias(f"_{k}") for k in ("game_id", "player_id", "start_sec", "end_sec")])
    met = events.join(c, "clip_id", "left")
    return checks.report([
        checks.issues(clips, "flat_pov", F.col("clip_id"), [("annotation_game_id_mismatch", F.col("game_id") != game_id)]),
        checks.issues(met, "flat_pov", F.col("event_id"), [
            ("unknown_clip", F.col("_game_id").isNull()), ("identity_mismatch", (F.col("game_id") != F.col("_game_id")) | (F.col("player_id") != F.col("_player_id"))),
            ("outside_clip", (F.col("start_sec") < F.col("_start_sec")) | (F.col("end_sec") < F.col("start_sec")) | (F.col("end_sec") > F.col("_end_sec"))),
        ]),
    ])


def gold_rows(gold: DataFrame) -> DataFrame:
    """Gold annotations of phases: contents that their kind must have, observations' sources and visibility, questions' risk.

    gold: annotation_file, phase_type, observations (array of struct(source_types, visibility)), utterances (array), tom_questions
    (array of struct(risk_of_perspective_leakage, needs_human_review)), gameplay_round_index, meeting_round_index."""
    known = F.array(*[F.lit(x) for x in SOURCE_TYPES])
    o, q = F.col("observations"), F.col("tom_questions")
    kind = F.col("phase_type")
    bad = lambda r: ~F.coalesce(r.isin(*RISKS), F.lit(False))
    return checks.issues(gold, "gold", F.col("annotation_file"), [
        ("gameplay_missing_round_index", (kind == "gameplay") & F.col("gameplay_round_index").isNull()), ("meeting_missing_round_index", (kind == "meeting") & F.col("meeting_round_index").isNull()), ("final_has_round_index", (kind == "final") & (F.col("gameplay_round_index").isNotNull() | F.col("meeting_round_index").isNotNull())),
        ("gameplay_empty_observations", (kind == "gameplay") & (F.size(o) == 0)), ("meeting_empty_utterances", (kind == "meeting") & (F.size("utterances") == 0)), ("empty_tom_questions", F.size(q) == 0),
        ("bad_observation_source_types", F.exists(o, lambda x: (F.size(F.coalesce(x["source_types"], payload.nothing())) == 0) | (F.size(F.array_except(F.coalesce(x["source_types"], payload.nothing()), known)) > 0))),
        ("bad_observation_visibility", F.exists(o, lambda x: ~F.coalesce(x["visibility"].isin(*VISIBILITY), F.lit(False)))), ("bad_leakage_risk", F.exists(q, lambda x: bad(x["risk_of_perspective_leakage"]))),
        ("leakage_not_reviewed", F.exists(q, lambda x: x["risk_of_perspective_leakage"].isin("medium", "high") & ~F.coalesce(x["needs_human_review"], F.lit(False)))),
    ])


def envelopes(rows: DataFrame, required: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """Annotation files against their place: `item` (VARIANT), annotation_file, player_id, phase_id."""
    lost = F.array_join(F.array_compact(F.array(*[F.when(~payload.given("item", k), F.lit(k)) for k in required])), ",")
    t = lambda k: F.try_variant_get("item", f"$.time.{k}", "double")
    start, end, length = t("aligned_start_sec"), t("aligned_end_sec"), t("duration_sec")
    top = lambda k, want: F.abs(payload.number("item", k, -1e9) - want) > tolerance
    kind = payload.string("item", "phase_type")
    differs = lambda k: ~payload.string("item", k).eqNullSafe(F.col(k))
    return checks.issues(rows, "envelope", F.col("annotation_file"), [
        ("missing_required_annotation_fields", lost != ""), ("annotation_file_mismatch", differs("annotation_file")), ("player_id_mismatch", differs("player_id")), ("phase_id_mismatch", differs("phase_id")),
        ("invalid_time_values", start.isNull() | end.isNull() | length.isNull()), ("invalid_time_range", (end <= start) | (F.abs(end - start - length) > tolerance)), ("top_level_time_mismatch", top("aligned_start_sec", start) | top("aligned_end_sec", end) | top("duration_sec", length)),
        ("gameplay_missing_trace", (kind == "gameplay") & ~payload.given("item", "gameplay_trace")), ("meeting_missing_utterances", (kind == "meeting") & ~payload.given("item", "utterances")),
    ], F.nullif(lost, F.lit("")))


def review_gate() -> Column:
    """struct(ok, reasons) of a reviewer's record."""
    return checks.gate([
        ("missing_probe_group_id", F.coalesce(F.col("probe_group_id").cast("string"), F.lit("")) == ""), ("decision_not_accept", ~F.coalesce(F.col("gate_decision") == "accept_human_verified", F.lit(False))), ("reviewer_not_trusted", ~F.coalesce(F.col("reviewer_trusted"), F.lit(False))),
        ("missing_evidence_checked", F.coalesce(F.size("evidence_checked"), F.lit(0)) <= 0), ("remaining_uncertainties_nonempty", F.coalesce(F.size("remaining_uncertainties"), F.lit(0)) > 0), ("still_needs_human_review", F.col("needs_human_review_after")),
    ])


def scope_gate() -> Column:
    """struct(ok, reasons): whether a merged claim may be used within its scope."""
    no = lambda c, v: ~F.coalesce(F.col(c) == v, F.lit(False))
    return checks.gate([("not_merge_candidate", no("merge_decision", "accept")), ("not_safe_for_drafts", no("safe_for_drafts", True)), ("transcript_not_exact", no("transcript_match", "exact")), ("text_confidence_not_high", no("text_confidence", "high")), ("speaker_confidence_not_high", no("speaker_confidence", "high"))])


def merge_decision(players: Column) -> Column:
    """accept or reject of a claim candidate: exact sure words, a known sure speaker, known targets, some use."""
    yes = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    words = yes("transcript_match", "exact") & yes("text_confidence", "high")
    speaker = F.coalesce(F.array_contains(players, F.col("canonical_speaker")), F.lit(False)) & yes("speaker_confidence", "high")
    targets = F.size(F.array_except(F.coalesce("claim_target_players", payload.nothing()), players)) == 0
    return F.when(words & speaker & targets & (F.coalesce(F.size("suggested_probe_uses"), F.lit(0)) > 0), "accept").otherwise("reject")


def claim_audit(players: Column) -> Column:
    """struct(issues, priority) of a claim that a model heard in a meeting."""
    targets = F.coalesce("claim_target_players", payload.nothing())
    speaker = F.col("canonical_speaker")
    found = checks.codes([
        ("invalid_claim_target_players", F.size(F.array_except(targets, players)) > 0), ("needs_human_review_not_true", ~F.coalesce("needs_human_review", F.lit(False))), ("invalid_canonical_speaker", ~F.coalesce(F.array_contains(players, speaker) | (speaker == "unknown"), F.lit(False))),
    ])
    high = (F.col("tom_relevance") == "high") & (F.col("text_confidence") == "high")
    return F.struct(found.alias("issues"), F.when(high, "high").when(F.col("tom_relevance").isin("high", "medium"), "medium").otherwise("low").alias("priority"))


def audio_audit(players: Column) -> Column:
    """struct(issues, may_merge) of a confirmation by ear: a known decision, a review still to come, known names; and whether it
    may go on to the merge gate."""
    speaker = F.col("canonical_speaker")
    found = checks.codes([
        ("parse_not_ok", ~F.coalesce("parse_ok", F.lit(False))), ("invalid_decision", ~F.coalesce(F.col("decision").isin(*AUDIO_DECISIONS), F.lit(False))), ("claims_direct_eligibility", F.col("eligible_for_merge")), ("needs_human_review_not_true", ~F.coalesce("needs_human_review", F.lit(False))),
        ("invalid_canonical_speaker", ~F.coalesce(F.array_contains(players, speaker) | (speaker == "unknown"), F.lit(False))), ("invalid_claim_target_players", F.size(F.array_except(F.coalesce("claim_target_players", payload.nothing()), players)) > 0),
    ])
    good = F.col("decision").isin(*PROMOTABLE) & F.col("evidence_quality").isin("high", "medium") & F.col("transcript_match").isin("exact", "minor_correction") & F.array_contains(players, speaker) & F.col("speaker_confidence").isin("high", "medium")
    return F.struct(found.alias("issues"), ((F.size(found) == 0) & F.coalesce(good, F.lit(False))).alias("may_merge"))


def field_report(df: DataFrame, fields: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Value counts of several fields and counts of flags, in one table: field, value, n."""
    counted = aggregates.counters(df, fields)
    named = df.agg(*[F.count_if(c).alias(n) for n, c in flags.items()], F.count("*").alias("rows"))
    return counted.unionByName(named.select(F.explode(F.array(*[F.struct(F.lit("(flag)").alias("field"), F.lit(n).alias("value"), F.col(n).alias("n")) for n in [*flags, "rows"]])).alias("x")).select("x.field", "x.value", "x.n"))


def judge_mean(df: DataFrame, key: Sequence[str], correct: str, reference: str, score: str) -> DataFrame:
    """Mean score of rows whose first answer is right and that have a reference: n, mean (0 without rows). Zeros count."""
    ok = F.coalesce(F.col(correct), F.lit(False)) & (F.coalesce(F.col(reference), F.lit("")) != "") & F.col(score).isNotNull()
    return df.groupBy(*key).agg(F.count_if(ok).alias("n"), F.coalesce(F.avg(F.when(ok, F.col(score).cast("double"))), F.lit(0.0)).alias("mean"))


def label_accuracy(predictions: DataFrame, gold: DataFrame, key: str = "trial_id") -> DataFrame:
    """Predictions against gold labels: accuracy, leakage, parse and schema rates over all predictions; one without gold is wrong
    unless it predicts nothing. predictions: key, prediction, used_forbidden, parse_ok, schema_ok; gold: key, label."""
    met = predictions.join(gold.select(key, "label"), key, "left")
    rate = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    return met.agg(F.count("*").alias("total"), rate(F.col("prediction").eqNullSafe(F.col("label"))).alias("label_accuracy"), rate(F.col("used_forbidden")).alias("leakage_rate"), F.count_if("used_forbidden").alias("forbidden_count"), rate(F.col("parse_ok")).alias("parse_rate"), rate(F.col("schema_ok")).alias("schema_rate"))


def letter_score(prediction: Column, correct: Column) -> Column:
    """Whether the letter is the right one; false where no right one is known."""
    return F.coalesce((text.stripped(correct) != "") & (prediction == F.upper(text.stripped(correct))), F.lit(False))


def progress(item: Column | str) -> Column:
    """struct of a result file's counters, zeros and "-" where it has none."""
    whole = lambda k: payload.number(item, k, 0.0).cast("bigint").alias(k)
    return F.struct(*[whole(k) for k in ("processed", "total", "correct", "skipped_banned", "skipped_failed")], F.coalesce(payload.string(item, "next_pending_id"), F.lit("-")).alias("next_pending_id"))


def aligned_export(trials: DataFrame, events: DataFrame, offsets: DataFrame, before: float = 8.0, after: float = 8.0, longest: float = 60.0) -> DataFrame:
    """Trials cut to their first supporting event that exists: the window in session and source time, the mark within it, and
    why a trial is left out (`skipped`).

    trials: trial_id, target_player_id, supporting_global_event_ids; events: global_event_id, game_id, start_sec, end_sec,
    source_player_ids; offsets: game_id, player_id, raw_start_sec. The source is the trial's target if among the event's, else the first.
    """
    named = trials.select("trial_id", F.posexplode("supporting_global_event_ids").alias("_pos", "global_event_id"))
    first = joins.first_per(named.join(events, "global_event_id"), ["trial_id"], ["_pos"]).drop("_pos")
    rows = trials.select("trial_id", "target_player_id").join(first, "trial_id", "left")
    source = F.when(F.array_contains("source_player_ids", F.col("target_player_id")), F.col("target_player_id")).otherwise(F.get("source_player_ids", 0))
    rows = rows.withColumn("player_id", source).join(offsets.select("game_id", "player_id", F.col("raw_start_sec").alias("offset_sec")), ["game_id", "player_id"], "left")
    w = numbers.context_window(F.col("start_sec"), F.col("end_sec"), before, after, longest)
    rows = rows.withColumns({"aligned_start_sec": w["start_sec"], "aligned_end_sec": w["end_sec"]})
    rows = rows.withColumns({"raw_start_sec": F.col("offset_sec") + F.col("aligned_start_sec"), "raw_end_sec": F.col("offset_sec") + F.col("aligned_end_sec"), "event_timestamp": F.greatest(F.lit(0.0), F.col("start_sec") - F.col("aligned_start_sec"))})
    rows = rows.withColumns({c: F.when(F.col("global_event_id").isNotNull(), F.col(c)) for c in ("aligned_start_sec", "event_timestamp")})
    why = F.when(F.col("global_event_id").isNull(), "no_event").when(F.col("offset_sec").isNull(), "no_offset").when(F.col("raw_end_sec") <= F.col("raw_start_sec"), "empty_window")
    return rows.withColumn("skipped", why)


def two_step_questions(exported: DataFrame, trials: DataFrame) -> DataFrame:
    """Exported samples as two questions: whether the clip suffices at the mark, and the trial's own."""
    met = exported.where("skipped is null").join(trials.select("trial_id", "question", "answer"), "trial_id")
    sample = F.concat_ws("_", "trial_id", "global_event_id", F.col("player_id").cast("string"))
    one = F.struct(F.format_string("%.3f", "event_timestamp").alias("timestamp"), F.lit("YES").alias("option_A"), F.lit("NO").alias("option_B"), F.lit("A").alias("correct_answer"))
    return met.select(sample.alias("video_id"), one.alias("question_1"), F.struct("question", "answer").alias("question_2"))


def _meaningful(value: Column) -> Column:
    return F.coalesce(~text.stripped(value).isin(*MEANINGLESS), F.lit(False))


def source_types(item: str = "item") -> Column:
    """Which source flags of an observation say something; plain sight where none does. False says nothing."""
    flags = [F.when(_meaningful(F.when(payload.kind(item, k) == "boolean", F.when(payload.flag(item, k), "true").otherwise("")).otherwise(payload.string(item, k))), F.lit(k)) for k in SOURCE_TYPES]
    found = F.array_compact(F.array(*flags))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("direct_visual_observation")))


def visibility_of(types: Column) -> Column:
    has = lambda k: F.array_contains(types, F.lit(k))
    return F.when(has("hidden_or_not_visible_information"), "hidden").when(has("inferred_belief"), "inferred").when(has("speech_claim"), "heard_speech").when(has("public_result"), "public").otherwise("pov_visible")


def question_sources(said: Column) -> Column:
    """What a question's words ask to be seen, heard or inferred; sight where they tell nothing."""
    found = F.array_compact(F.array(*[F.when(text.contains_any(said, marks), F.lit(name)) for name, marks in SOURCE_MARKS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("direct_visual_observation")))


def answerable(sources: Column) -> Column:
    video = F.array_contains(sources, F.lit("direct_visual_observation")) | F.array_contains(sources, F.lit("public_result"))
    audio = F.array_contains(sources, F.lit("speech_claim"))
    return F.when(video & audio, "video_audio").when(video, "video_only").when(audio, "audio_only").otherwise("not_answerable_without_gold")


def prompt_texts(prompts: Column) -> Column:
    """map letter -> prompt of an array of struct(prompt_id, probe_type, prompt); the last of a letter counts, others are dropped."""
    out = F.create_map().cast("map<string,string>")
    for letter, names in PROMPT_NAMES.items():
        own = F.filter(prompts, _named(names))
        out = F.map_concat(out, F.when(F.size(own) > 0, F.create_map(F.lit(letter), F.element_at(own, -1)["prompt"])).otherwise(F.create_map().cast("map<string,string>")))
    return out


def _named(names: Sequence[str]) -> Callable[[Column], Column]:
    return lambda p: F.coalesce(F.coalesce(F.nullif(p["prompt_id"], F.lit("")), p["probe_type"]).isin(*names), F.lit(False))


def prompt_is_safe(probe_type: Column, prompt: Column) -> Column:
    """A prompts carry the public query and no scorer's mark; D prompts not the listener's context."""
    said = F.coalesce(prompt, F.lit(""))
    a, d = probe_type == PROMPT_NAMES["A"][1], probe_type == PROMPT_NAMES["D"][1]
    return ~(a & (~said.contains("QUERY_VARIABLE_PUBLIC_FORM_JSON") | text.contains_any(said, LEAK_MARKS))) & ~(d & said.contains("TARGET_LISTENER_CONTEXT_JSON"))


def public_query(group: Sequence[str] = ("target_player", "cutoff_abs_sec", "related_claim_ids", "available_evidence_ids_for_target")) -> Column:
    """JSON of what a prompt may say about a group: the query, the target and what the target has."""
    return F.to_json(F.struct(F.coalesce("query_type", F.lit("unknown")).alias("query_type"), F.coalesce("proposition", F.lit("")).alias("proposition"), *group, F.lit(TASK_OF_QUERY).alias("task")))


def repaired_a(prompt: Column, header: Column, query: Column, target: Column) -> Column:
    """An A prompt rebuilt round the target's own context, which is cut out of the old one."""
    context = text.stripped(F.substring_index(F.substring_index(prompt, "TARGET_AVAILABLE_CONTEXT_JSON:", -1), "QUESTION:", 1))
    kept = F.when(prompt.contains("TARGET_AVAILABLE_CONTEXT_JSON:"), context).otherwise("{}")
    return F.concat_ws("\n", header, F.lit("QUERY_VARIABLE_PUBLIC_FORM_JSON:"), query, F.lit("TARGET_AVAILABLE_CONTEXT_JSON:"), kept, F.concat(F.lit("QUESTION: From the view of "), target, F.lit(" at cutoff, answer the public query above. Return strict JSON matching the schema.")))


def repaired_d(groups: DataFrame, claims: DataFrame, snapshots: DataFrame, players: Column) -> DataFrame:
    """D prompts rebuilt from the speaker's own context and what is public of the listener, both as of the cutoff.

    groups: probe_group_id, game_id, target_player, cutoff_abs_sec, related_claim_ids; the speaker is that of the first claim."""
    told = groups.select("probe_group_id", F.posexplode("related_claim_ids").alias("_pos", "claim_id")).join(claims.select("claim_id", "speaker", "content"), "claim_id")
    said = told.groupBy("probe_group_id").agg(F.min_by("speaker", "_pos").alias("speaker"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "claim_id", "content"))), lambda x: F.struct(x["claim_id"].alias("claim_id"), x["content"].alias("content")))).alias("_claims"))
    rows = groups.join(said, "probe_group_id", "left").withColumn("speaker", F.when(F.array_contains(players, F.col("speaker").cast("string")), F.col("speaker").cast("string")).otherwise("unknown"))
    snaps = snapshots.select("game_id", F.col("target_player").cast("string").alias("_who"), F.col("cutoff_abs_sec").alias("_at"), "public_history", "private_observations", "heard_claims")
    for who, keys in (("speaker", ("public_history", "private_observations", "heard_claims")), ("target_player", ("public_history", "heard_claims"))):
        own = snaps.select("game_id", F.col("_who").alias(f"_{who}"), "_at", F.to_json(F.struct(*keys)).alias(f"{who}_context"))
        rows = joins.asof_join(rows.withColumn(f"_{who}", F.col(who).cast("string")), own, "cutoff_abs_sec", "_at", ["game_id", f"_{who}"], order=["_at"]).drop("_at", f"_{who}")
    part = lambda c: F.coalesce(F.col(c), F.lit("{}"))
    prompt = F.concat_ws("\n", F.lit("RELATED_CLAIMS_JSON:"), F.coalesce("_claims", F.lit("[]")), F.lit("SPEAKER_AVAILABLE_CONTEXT_JSON:"), part("speaker_context"), F.lit("SPEAKER_MODEL_OF_LISTENER_PUBLIC_HISTORY_JSON:"), part("target_player_context"), F.concat(F.lit("QUESTION: From the view of "), F.col("speaker"), F.lit(", predict how the listener takes the claim.")))
    return rows.withColumn("prompt", prompt).drop("_claims", "speaker_context", "target_player_context")


def frame_state(raw: Column) -> Column:
    """struct(state, reason) of a frame's label: the JSON's own state if known, else one that the text names."""
    item = F.try_parse_json(raw)
    own = text.stripped(F.try_variant_get(item, "$.state", "string"))
    flat = F.replace(F.lower(F.coalesce(raw, F.lit(""))), F.lit(" "), F.lit(""))
    guess = F.when(flat.contains("in_game") | flat.contains("ingame"), "in_game").when(flat.contains("start_screen") | flat.contains("startscreen"), "start_screen").otherwise("other")
    return F.struct(F.when(own.isin("in_game", "start_screen", "other"), own).otherwise(guess).alias("state"), F.substring(F.coalesce(F.try_variant_get(item, "$.reason", "string"), F.lit("")), 1, 40).alias("reason"))


def refine_bounds(labels: DataFrame, key: Sequence[str], at: str, state: str) -> DataFrame:
    """Between a start screen and a game seen coarsely, finer labels: the first time in game, and the last start screen ahead of it."""
    return windows.entry_bounds(labels, key, at, state, "start_screen", "in_game")


def aligned_window(prompt: Column) -> Column:
    """struct(start_sec, end_sec) of `aligned_time=[a, b]` in a prompt; null where there is none."""
    n = r"(-?\d+(?:\.\d+)?)"
    pattern = rf"aligned_time=\[\s*{n}\s*,\s*{n}\s*\]"
    got = lambda i: F.regexp_extract(prompt, pattern, i).try_cast("double")
    return F.when(prompt.rlike(pattern), F.struct(got(1).alias("start_sec"), got(2).alias("end_sec")))


def answer_schema(probe_type: Column) -> Column:
    """map field -> type that a probe of this type must answer with."""
    maps = {k: F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) for k, v in ANSWER_KEYS.items()}
    out = maps[""]
    for name, m in maps.items():
        out = F.when(probe_type == name, m).otherwise(out) if name else out
    return out
