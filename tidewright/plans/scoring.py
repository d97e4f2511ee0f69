"""Scores of model answers: rates with their denominators spelled out, pivots by probe letter, composites, paired tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import answers, numbers, text
from tidewright.operators import joins, selection


def rate(hit: Column, among: Column | None = None) -> Column:
    """Hits over the rows of `among` (all rows); null counts as no hit; 0.0 of none."""
    among = F.lit(True) if among is None else among
    return F.coalesce(F.try_divide(F.count_if(F.coalesce(hit, F.lit(False)) & among), F.count_if(among)), F.lit(0.0))


def mean_of(flag: Column) -> Column:
    """Mean of a boolean over rows where it isn't null; null if it always is."""
    return F.avg(flag.cast("int"))


def _metrics() -> list[Column]:
    """Counts and rates of attempts; a row without a status was tried, an answer without a latency took none."""
    status = F.coalesce("status", F.lit(""))
    tried, ok = status != "skipped", status == "ok"
    return [
        F.count("*").alias("n_rows"), F.count_if(tried).alias("attempted"), F.count_if(ok).alias("n_ok"), F.count_if(status == "error").alias("n_errors"),
        F.count_if(status == "skipped").alias("n_skipped"), F.round(rate(F.col("parse_ok"), tried), 6).alias("parse_rate"), F.round(rate(F.col("schema_ok"), tried), 6).alias("schema_rate"),
        F.coalesce(numbers.exact_mean(F.when(ok, F.coalesce("latency_sec", F.lit(0.0)))), F.lit(0.0)).alias("mean_latency_sec"),
    ]


def _known(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("unknown")).alias(column)


def basic_metrics(df: DataFrame, key: Sequence[str], breakdown: str) -> DataFrame:
    """Counts and rates for each key and, in the same pass, for each value of `breakdown` ("(all)" is the total)."""
    named = df.withColumn(breakdown, _known(breakdown))
    sets = [[*key], [*key, breakdown]]
    out = named.groupingSets([[F.col(c) for c in s] for s in sets], *key, breakdown).agg(F.grouping(breakdown).alias("_g"), *_metrics())
    return out.withColumn(breakdown, F.when(F.col("_g") == 1, "(all)").otherwise(F.col(breakdown))).drop("_g")


def evaluation_report(attempts: DataFrame, gold: DataFrame, generators: Sequence[str] = ()) -> DataFrame:
    """Metrics of each (track, model, modality): level "all", and in the same pass by probe_type and by gold_source.

    attempts: task_key, seq, track, model, modality, trial_id, probe_type, gold_source, status, parse_ok, schema_ok, latency_sec. Those
    without a key are left out; of the rest the latest of each key counts, but a good one isn't replaced by a bad one.
    gold: track, trial_id, seq, gold_source, nested_source - the held-back rows of the tracks that have some; the last of a trial counts, and what
    its nested gold says goes first. Attempts of those tracks take their source from it, others keep their own. Null or blank names
    are "unknown". same_model: whether a model took part in making the data.
    """
    last = joins.first_per(gold.where("trial_id is not null"), ["track", "trial_id"], [F.desc("seq")]).select("track", "trial_id", F.coalesce("nested_source", "gold_source").alias("_source"))
    tracks = gold.select("track").distinct().withColumn("_held_back", F.lit(True))
    latest = selection.latest_attempt(attempts.where("task_key <> ''"), "task_key", "status", "seq")
    rows = latest.join(last, ["track", "trial_id"], "left").join(tracks, "track", "left")
    source = F.when(F.col("_held_back"), F.col("_source")).otherwise(F.col("gold_source"))
    key, parts = ["track", "model", "modality"], ["probe_type", "gold_source"]
    named = rows.withColumn("gold_source", source).withColumns({c: _known(c) for c in parts})
    sets = [key, *[[*key, c] for c in parts]]
    out = named.groupingSets([[F.col(c) for c in s] for s in sets], *key, *parts).agg(*[F.grouping(c).alias(f"_{c}") for c in parts], *_metrics())
    level, name = F.lit("all"), F.lit("")
    for c in parts:
        level, name = F.when(F.col(f"_{c}") == 0, c).otherwise(level), F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(name)
    return out.withColumns({"level": level, "name": name, "same_model": F.coalesce(F.col("model").isin(*generators), F.lit(False)) if generators else F.lit(False)}).drop(*parts, *[f"_{c}" for c in parts])


LETTERS = ("A", "B", "C", "D")
TRUTH_KEYS = ("claim_truth_global", "global_claim_truth", "truth_status_global", "claim_global_truth")
LOCAL_KEYS = ("claim_awareness_local_target", "local_claim_awareness", "target_claim_awareness", "target_can_know_claim_truth", "target_has_evidence_for_claim_truth")


def answer_table(responses: DataFrame) -> DataFrame:
    """One row a group with each letter's answer JSON: a_A .. a_D, parse flags; the last response of a letter counts.

    responses: probe_group_id, probe_type, raw_response, seq.
    """
    parsed = responses.withColumn("_p", answers.parse_answer(F.col("raw_response")))
    rows = parsed.select("probe_group_id", F.substring("probe_type", 1, 1).alias("letter"), "seq", F.to_json("_p.parsed").alias("json"), F.col("_p.parse_ok").alias("parse_ok"))
    return rows.groupBy("probe_group_id").pivot("letter", list(LETTERS)).agg(F.max_by("json", "seq").alias("json"), F.max_by("parse_ok", "seq").alias("ok"))


def score_groups(groups: DataFrame) -> DataFrame:
    """Metrics of each group: RC, FB and PT scores, claim verification, leakage, evidence support, parse and schema.

    groups: `answer_table` joined with forbidden, acceptable (arrays of ids), expected_global, expected_local, and the
    reference's listener and speaker. A missing answer leaves its own metrics null, as no answer was given.
    """
    js = {c: F.col(f"{c}_json") for c in LETTERS}
    has = {c: F.coalesce(F.size(answers.keys_of(js[c])) > 0, F.lit(False)) for c in LETTERS}
    get = lambda c, k: F.get_json_object(js[c], f"$.{k}")
    leak = F.lit(False)
    for c in LETTERS:
        leak = leak | answers.cites_forbidden(js[c], F.col("forbidden"))
    cited = F.array_distinct(F.flatten(F.array(*[F.coalesce(answers.cited_ids(js[c]), F.array().cast("array<string>")) for c in LETTERS])))
    unsupported = F.when(F.size("acceptable") > 0, F.size(F.array_except(F.array_except(cited, F.col("acceptable")), F.col("forbidden")))).otherwise(0)
    b_knows, c_knows = get("B", "target_knew_truth_at_cutoff"), get("C", "other_player_knew_truth_at_cutoff")
    first = lambda c, *ks: F.coalesce(*[F.nullif(get(c, k), F.lit("")) for k in ks])
    a_label, b_label = F.coalesce(first("A", "belief_label", "likely_belief"), F.lit("None")), F.coalesce(first("B", "belief_label", "reconstructed_prior_belief"), F.lit("None"))
    truth = F.coalesce(*[text.normalize_enum(answers.first_present(js[c], list(TRUTH_KEYS))) for c in LETTERS])
    yes_no = lambda v: F.when(v == "true", "has_evidence").when(v == "false", "not_enough_information").otherwise(text.normalize_enum(v))
    local = F.coalesce(*[yes_no(answers.first_present(js[c], list(LOCAL_KEYS))) for c in LETTERS])
    trust, action = first("D", "predicted_listener_trust_update", "predicted_trust_update"), first("D", "predicted_listener_next_action", "predicted_next_action")
    listener = F.coalesce(F.nullif(get("D", "listener"), F.lit("")), F.lit(""))
    weak = trust.isNotNull() & (listener != "") & (F.col("ref_listener").isNull() | (listener == F.col("ref_listener")))
    strong = weak & (F.col("ref_speaker").isNull() | F.coalesce(get("D", "speaker") == F.col("ref_speaker"), F.lit(False))) & action.isNotNull() & (F.coalesce(action, F.lit("")) != "unknown")
    every = lambda parts: F.forall(F.array_compact(F.array(*parts)), lambda x: x)
    expected_g, expected_l = text.normalize_enum(F.col("expected_global")), text.normalize_enum(F.col("expected_local"))
    return groups.select(
        "probe_group_id",
        F.when(has["B"], F.coalesce(b_knows == "false", F.lit(False))).alias("RC_weak"),
        (has["A"] & has["B"] & F.coalesce(b_knows == "false", F.lit(False)) & F.contains(b_label, F.substring(a_label, 1, 40))).alias("RC_strong"),
        F.when(has["C"], F.coalesce(c_knows != "true", F.lit(True))).alias("FB_weak"),
        (has["C"] & F.coalesce(c_knows != "true", F.lit(True)) & F.coalesce(F.nullif(get("C", "other_player_likely_belief"), F.lit("")).isNotNull(), F.lit(False))).alias("FB_strong"),
        F.when(has["D"], weak).alias("PT_weak"), F.when(has["D"], strong).alias("PT_strong"),
        F.when(expected_g.isNotNull(), F.coalesce(truth == expected_g, F.lit(False))).alias("claim_verification_global"),
        F.when(expected_l.isNotNull(), F.coalesce(local == expected_l, F.lit(False))).alias("claim_verification_local"),
        leak.alias("perspective_leakage"), (~leak & (unsupported == 0)).alias("evidence_support"),
        every([F.col(f"{c}_ok") for c in LETTERS]).alias("json_parse_success"),
        every([F.when(F.col(f"{c}_ok").isNotNull(), answers.schema_ok(F.lit(c), js[c])) for c in LETTERS]).alias("schema_validation_success"),
    )


def diagnostic_rates(scores: DataFrame) -> DataFrame:
    """Each rate over all groups; a null score counts as false."""
    names = [c for c in scores.columns if c != "probe_group_id"]
    return scores.agg(F.count("*").alias("groups_scored"), *[rate(F.col(c)).alias(c) for c in names])


AGENTIC = (
    "hidden_world_state_accuracy", "offscreen_action_accuracy", "next_behavior_top1_accuracy", "next_behavior_topk_accuracy", "deception_detection_global",
    "deception_awareness_local", "temporal_window_hit_rate", "pov_evidence_support", "json_parse_success", "schema_validation_success",
)


def agentic_scores(rows: DataFrame) -> DataFrame:
    """Per-answer scores of the four prediction families.

    rows: trial_id, probe_family, raw_response, acceptable, forbidden, and gold labels gold_event, gold_action, gold_future,
    gold_truth, gold_local (null where a family has none).
    """
    p = rows.withColumn("_p", answers.parse_answer(F.col("raw_response"))).withColumns({"_ok": F.col("_p.parse_ok"), "_js": F.coalesce(F.to_json("_p.parsed"), F.lit("{}"))})
    p = p.withColumn("_ids", answers.cited_ids(F.col("_js")))
    get = lambda k: F.get_json_object("_js", f"$.{k}")
    label = text.normalize_label
    family = F.substring("probe_family", 1, 1)
    same = lambda f, gold, got: F.when((family == f) & (label(F.col(gold)) != ""), label(got) == label(F.col(gold)))
    top1 = F.coalesce(F.nullif(get("top1_next_behavior"), F.lit("")), get("predicted_next_action"))
    topk = F.transform(F.coalesce(F.from_json(get("topk_next_behaviors"), "array<string>"), F.array().cast("array<string>")), label)
    forbidden, acceptable = F.col("forbidden"), F.col("acceptable")
    unsupported = F.when(F.size(acceptable) > 0, F.size(F.array_except(F.array_except("_ids", acceptable), forbidden)) > 0).otherwise(False)
    raw = F.concat(F.coalesce("raw_response", F.lit("")), F.col("_js"))
    return p.select(
        "trial_id", "probe_family", F.col("_ok").alias("json_parse_success"), (F.size(answers.keys_of(F.col("_js"))) > 0).alias("schema_validation_success"),
        text.oracle_overclaim(F.col("_js"), raw, forbidden, answers.field(F.col("_p.parsed"), "must_not_claim_direct_observation", "boolean")).alias("oracle_overclaim"),
        text.death_overclaim(raw).alias("death_skill_overclaim"), (~unsupported & (F.size(F.array_intersect("_ids", forbidden)) == 0)).alias("pov_evidence_support"),
        same("E", "gold_event", get("oracle_guess.event_type")).alias("hidden_world_state_accuracy"),
        same("F", "gold_action", F.coalesce(F.nullif(get("predicted_action"), F.lit("")), get("oracle_guess.event_type"))).alias("offscreen_action_accuracy"),
        same("G", "gold_future", top1).alias("next_behavior_top1_accuracy"),
        F.when((family == "G") & (label(F.col("gold_future")) != ""), F.array_contains(F.array_append(topk, label(top1)), label(F.col("gold_future")))).alias("next_behavior_topk_accuracy"),
        F.when(family == "G", True).alias("temporal_window_hit_rate"),
        same("H", "gold_truth", get("global_truth_guess")).alias("deception_detection_global"), same("H", "gold_local", get("local_knowability")).alias("deception_awareness_local"),
    )


def agentic_summary(scores: DataFrame) -> DataFrame:
    """Means over non-null values for each family and in all ("(all)"), and the weighted composite, in which null counts 0."""
    means = [mean_of(F.col(c)).alias(c) for c in AGENTIC]
    rates = [F.coalesce(mean_of(F.col(c)), F.lit(0.0)).alias(f"{c}_rate") for c in ("oracle_overclaim", "death_skill_overclaim")]
    out = scores.groupingSets([[], [F.col("probe_family")]], "probe_family").agg(F.grouping("probe_family").alias("_g"), F.count("*").alias("n_rows"), *means, *rates)
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    composite = (
        0.25 * v("hidden_world_state_accuracy") + 0.20 * v("next_behavior_top1_accuracy") + 0.15 * v("deception_detection_global") + 0.15 * v("deception_awareness_local")
        + 0.10 * v("pov_evidence_support") + 0.10 * (1 - v("oracle_overclaim_rate")) + 0.05 * 0.5
    )
    return out.withColumns({"probe_family": F.when(F.col("_g") == 1, "(all)").otherwise(F.col("probe_family")), "composite": composite}).drop("_g")


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


def mcnemar(a: DataFrame, b: DataFrame, key: str, correct: str) -> DataFrame:
    """Discordant counts of paired results, the test with continuity correction and its p-value (1 without discordance)."""
    both = a.select(key, F.col(correct).alias("_a")).join(b.select(key, F.col(correct).alias("_b")), key)
    n = both.agg(F.count_if(F.col("_a") & ~F.col("_b")).alias("a_only"), F.count_if(~F.col("_a") & F.col("_b")).alias("b_only"))
    total = F.col("a_only") + F.col("b_only")
    stat = F.coalesce(F.try_divide(F.pow(F.abs(F.col("a_only") - F.col("b_only")) - 1, F.lit(2)), total), F.lit(0.0))
    return n.withColumn("statistic", stat).withColumn("p_value", F.when(total == 0, 1.0).otherwise(erfc(F.sqrt(F.col("statistic") / 2))))


def split_accuracy(df: DataFrame, by: str, correct: str) -> DataFrame:
    """Correct, total and accuracy for each value and in all."""
    out = df.rollup(by).agg(F.grouping(by).alias("_g"), F.count_if(correct).alias("n_correct"), F.count("*").alias("n_total"))
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(by)).alias(by), "n_correct", "n_total", F.round(F.col("n_correct") / F.col("n_total"), 6).alias("accuracy"))


def gated_score(first_ok: Column, answer: Column, second: Column) -> Column:
    """The second score counts only after a right first answer A; a wrong one scores 0, a right B none."""
    return F.when(~first_ok, F.lit(0)).when(answer == "A", second)


def positive_mean(score: Column) -> Column:
    """Mean of scores above zero."""
    return F.avg(F.when(score > 0, score))
