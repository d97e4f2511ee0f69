"""Constraint checks as issue tables: (check, code, key, detail), one row for each rule that a row breaks.

A rule is a code and a Column that is true where the rule is broken; null counts as not broken. Checks across rows (foreign
keys, duplicates, coverage, counts) are joins and groupings that end in the same four columns, so reports are unions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import joins, patterns, windows

ISSUE = ("check", "code", "key", "detail")


def codes(rules: Sequence[tuple[str, Column]]) -> Column:
    """The codes of the broken rules, in their order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules]))


def issues(df: DataFrame, check: str, key: Column, rules: Sequence[tuple[str, Column]], detail: Column | None = None) -> DataFrame:
    each = df.select(F.lit(check).alias("check"), F.explode(codes(rules)).alias("code"), key.cast("string").alias("key"), (detail.cast("string") if detail is not None else F.lit(None).cast("string")).alias("detail"))
    return each


def report(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, check: str, key: str, code: str = "duplicate_id") -> DataFrame:
    n = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    return n.select(F.lit(check).alias("check"), F.lit(code).alias("code"), F.col(key).cast("string").alias("key"), F.col("_n").cast("string").alias("detail"))


def missing_parent(df: DataFrame, check: str, key: str, parent: DataFrame, parent_key: str, row_key: str, code: str = "unknown_reference") -> DataFrame:
    lost = df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return lost.select(F.lit(check).alias("check"), F.lit(code).alias("code"), F.col(row_key).cast("string").alias("key"), F.col(key).cast("string").alias("detail"))


def row_count(df: DataFrame, check: str, expected: DataFrame | int, code: str = "row_count") -> DataFrame:
    """An issue if the numbers of rows differ."""
    want = df.sparkSession.range(1).select(F.lit(expected).cast("long").alias("_want")) if isinstance(expected, int) else expected.agg(F.count("*").alias("_want"))
    both = df.agg(F.count("*").alias("_n")).crossJoin(want).where("_n <> _want")  # a row each
    return both.select(F.lit(check).alias("check"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("key"), F.format_string("%d rows, expected %d", "_n", "_want").alias("detail"))


def coverage(df: DataFrame, check: str, wanted: DataFrame, key: Sequence[str], code: str = "missing_output") -> DataFrame:
    """Wanted combinations without a row."""
    lost = wanted.join(df.select(*key).distinct(), list(key), "left_anti")
    return lost.select(F.lit(check).alias("check"), F.lit(code).alias("code"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"), F.lit(None).cast("string").alias("detail"))


def id_sets(check: str, sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids that aren't in all tables, with the tables that lack them."""
    odd = joins.reconcile(sides, key)
    lacking = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"in_{n}"), F.lit(n)) for n in sides])), ",")
    return odd.select(F.lit(check).alias("check"), F.lit("id_mismatch").alias("code"), F.col(key).cast("string").alias("key"), lacking.alias("detail"))


def leak_scan(lines: DataFrame, check: str, key: str, body: str, marks: Sequence[str] | DataFrame) -> DataFrame:
    """Each mark that a public line contains, an issue each. marks: texts, or a table with a column `mark`."""
    if not isinstance(marks, DataFrame):
        marks = lines.sparkSession.createDataFrame([(m,) for m in marks], "mark string")
    found = patterns.found_in(lines.select(F.col(key).cast("string").alias("key"), F.col(body).alias("body")), "body", marks.select(F.col("mark").alias("detail"), "mark").distinct(), "mark")
    return found.select(F.lit(check).alias("check"), F.lit("public_leak").alias("code"), "key", "detail")


def passages_in(docs: DataFrame, doc_id: str, body: str, items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(doc_id, item_id): passages that a document contains as a sequence of whole words; white space is one space on both sides."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    keys = items.select(F.col(item_id).alias("item_id"), flat(F.col(passage)).alias("passage"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), flat(F.col(body)).alias("body"))
    return patterns.found_in(rows, "body", keys, "passage", words=True).distinct()


def timed_evidence(df: DataFrame, key: str) -> DataFrame:
    return issues(df, "timed_evidence", F.col(key), [("local_order", F.col("local_end_sec") <= F.col("local_start_sec")), ("absolute_order", F.col("abs_end_sec") <= F.col("abs_start_sec")), ("certainty_range", ~F.col("certainty").between(0, 1))])


def segments(df: DataFrame, roster: Column) -> DataFrame:
    """segment_id, aligned_start_sec, aligned_end_sec, duration_sec, pov_count, povs."""
    players = F.transform("povs", lambda p: p["player_id"])
    off = F.exists("povs", lambda p: (p["aligned_start_sec"] != F.col("aligned_start_sec")) | (p["aligned_end_sec"] != F.col("aligned_end_sec")))
    return issues(df, "segments", F.col("segment_id"), [
        ("duration_mismatch", F.abs(F.col("aligned_end_sec") - F.col("aligned_start_sec") - F.col("duration_sec")) > 1e-6), ("pov_count", F.size("povs") != F.col("pov_count")),
        ("roster_mismatch", F.size(F.array_except(roster, players)) + F.size(F.array_except(players, roster)) > 0), ("duplicate_pov", F.size(F.array_distinct(players)) != F.size(players)), ("pov_time_mismatch", off),
    ])


def time_formula(df: DataFrame, key: str, tolerance: float = 0.06) -> DataFrame:
    """Absolute times are the phase's start plus local ones."""
    off = lambda a, l: F.abs(F.col(a) - (F.col("aligned_start_sec") + F.col(l))) > tolerance  # noqa: E731, E741
    return issues(df, "time_formula", F.col(key), [("start_formula", off("abs_start_sec", "local_start_sec")), ("end_formula", off("abs_end_sec", "local_end_sec")), ("outside_phase", (F.col("abs_start_sec") < F.col("aligned_start_sec") - tolerance) | (F.col("abs_end_sec") > F.col("aligned_end_sec") + tolerance))])


def alignment(mappings: DataFrame, players: DataFrame, median_limit: float = 1.0, p95_limit: float = 2.0, least: int = 3) -> DataFrame:
    """player_id, scale, offset, inlier_count, median_residual_sec, p95_residual_sec."""
    rows = players.select("player_id").join(mappings, "player_id", "left")
    gone = F.col("scale").isNull()
    return issues(rows, "alignment", F.col("player_id"), [
        ("missing_mapping", gone), ("few_anchors", ~gone & (F.col("inlier_count") < least)), ("median_residual", ~gone & (F.col("median_residual_sec") > median_limit)),
        ("p95_residual", ~gone & (F.col("p95_residual_sec") > p95_limit)), ("scale_range", ~gone & ~F.col("scale").between(0.95, 1.05)),
    ])


def contiguous_phases(phases: DataFrame, key: str) -> DataFrame:
    """Phases of an episode follow each other without gap or overlap, and none is empty."""
    w = Window.partitionBy(key).orderBy("abs_start_sec")
    rows = phases.withColumn("_prev", F.lag("abs_end_sec").over(w))
    return issues(rows, "contiguous_phases", F.concat_ws("|", key, "phase_index"), [("empty_phase", F.col("abs_end_sec") <= F.col("abs_start_sec")), ("gap", F.col("abs_start_sec") > F.col("_prev")), ("overlap", F.col("abs_start_sec") < F.col("_prev"))])


def anchor_residuals(rows: DataFrame, consensus: DataFrame, episodes: DataFrame, players: DataFrame, reach: float = 3.0, least: int = 3, median_limit: float = 1.0, p95_limit: float = 2.0) -> DataFrame:
    """How far each player's boundaries lie from those agreed on, within each episode: counts, median, p95 by index, issues."""
    a = consensus.select(F.col("boundary_type"), F.col("abs_sec").alias("_a"), F.monotonically_increasing_id().alias("_id"))
    placed = joins.range_join(a, episodes.select("episode_id", "abs_start_sec", "abs_end_sec"), ("_a", "_a"), ("abs_start_sec", "abs_end_sec"), 600.0)
    mine = rows.select("boundary_type", "player_id", F.col("aligned_start_sec").alias("_t"))
    met = joins.range_join(placed, mine, ("_a", "_a"), ("_t", "_t"), reach * 4, ["boundary_type"], reach, reach).where("_t between abs_start_sec and abs_end_sec")
    near = met.groupBy("episode_id", "player_id", "_id").agg(F.min(F.abs(F.col("_t") - F.col("_a"))).alias("_r"))
    s = F.array_sort(F.collect_list("_r"))
    stats = near.groupBy("episode_id", "player_id").agg(F.count("*").alias("anchor_count"), F.percentile("_r", F.lit(0.5)).alias("median_residual_sec"), F.get(s, F.least(F.count("*") - 1, F.floor(F.count("*") * 0.95)).cast("int")).alias("p95_residual_sec"))
    grid = joins.grid(episodes.select("episode_id"), players.select("player_id")).join(stats, ["episode_id", "player_id"], "left")
    grid = grid.withColumn("anchor_count", F.coalesce("anchor_count", F.lit(0).cast("long")))
    code = F.when(F.col("anchor_count") < least, "few_anchors").when(F.col("median_residual_sec") > median_limit, "median_residual").when(F.col("p95_residual_sec") > p95_limit, "p95_residual")
    return grid.withColumn("issue", code)


def claim_hearing(df: DataFrame, key: str, roster: Column) -> DataFrame:
    heard = F.col("heard_by")
    everyone = (F.size(F.array_except(roster, heard)) == 0) & (F.size(F.array_except(heard, roster)) == 0)
    return issues(df, "claim_hearing", F.col(key), [
        ("no_heard_by", heard.isNull()), ("unknown_hearer", F.size(F.array_except(heard, roster)) > 0), ("private_heard_by_all", everyone & ~F.coalesce("meeting_public", F.lit(False))),
        ("unknown_speaker", F.col("speaker_id").isNotNull() & ~F.array_contains(roster, F.col("speaker_id"))), ("no_evidence", ~F.coalesce("audio_admissible", F.lit(False)) & (F.coalesce("visual_text_evidence_id", F.lit("")) == "")),
    ])


def perception_pass(df: DataFrame, key: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Of each clip: forbidden types, repeated descriptions, a uniform grid, long task screens."""
    said = F.lower(F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"(?U)\s+", " ")))
    rows = df.withColumn("_said", said)
    most = rows.groupBy(*key, "_said").agg(F.count("*").alias("_k")).groupBy(*key).agg(F.max("_k").alias("_most"), F.count("*").alias("_kinds"), F.sum("_k").alias("_n"))
    bad = rows.groupBy(*key).agg(F.count_if(~F.col("event_type").isin(*allowed)).alias("_bad"), F.count_if((F.col("event_type") == "task_ui") & (F.col("end_sec") - F.col("start_sec") > 20)).alias("_long"))
    grid = windows.uniform_grid(rows, list(key), "start_sec", "end_sec").select(*key, "is_grid")
    both = most.join(bad, list(key)).join(grid, list(key))
    return issues(both, "perception_pass", F.concat_ws("|", *key), [("forbidden_type", F.col("_bad") > 0), ("templated_descriptions", (F.col("_n") >= 4) & (F.col("_kinds") / F.col("_n") < 0.6)), ("repeated_description", F.col("_most") > 2), ("uniform_grid", F.col("is_grid")), ("long_task_ui", F.col("_long") > 0)])


def trial_rows(trials: DataFrame) -> DataFrame:
    """Known splits and layers, one split a group, gold present, four variants."""
    row = issues(trials, "trials", F.col("trial_id"), [("unknown_split", ~F.col("split").isin("train", "dev", "test")), ("no_evidence", F.size("evidence_ids") == 0)])
    groups = trials.groupBy("probe_group_id").agg(F.count_distinct("split").alias("_s"), F.count("*").alias("_n"))
    return row.unionByName(issues(groups, "trials", F.col("probe_group_id"), [("group_in_two_splits", F.col("_s") > 1), ("variant_count", F.col("_n") != 4)]))


def ledger_rows(ledger: dict[str, DataFrame], players: DataFrame) -> DataFrame:
    """Times in order, an edge for each event and player, links to known claims and events, unique ids."""
    events, edges, links = ledger["world_events"], ledger["visibility_edges"], ledger["claim_truth_links"]
    wanted = joins.grid(events.select(F.col("world_event_id").alias("event_id")), players.select("player_id"))
    linked = links.select("claim_truth_link_id", "claim_id", F.explode("world_event_ids").alias("world_event_id"))
    return report([
        issues(events, "world_events", F.col("world_event_id"), [("time_order", F.col("abs_end_sec") <= F.col("abs_start_sec")), ("certainty_range", ~F.col("certainty").between(0, 1)), ("no_source", F.size("source_povs") == 0)]),
        duplicate_keys(events, "world_events", "world_event_id"), duplicate_keys(ledger["claims"], "claims", "claim_id"), duplicate_keys(edges, "visibility_edges", "edge_id"), coverage(edges, "visibility_edges", wanted, ["event_id", "player_id"], "missing_edge"),
        missing_parent(linked, "claim_truth_links", "claim_id", ledger["claims"], "claim_id", "claim_truth_link_id"), missing_parent(linked, "claim_truth_links", "world_event_id", events, "world_event_id", "claim_truth_link_id"),
    ])


def judgement(df: DataFrame, key: str, allowed_evidence: Column) -> DataFrame:
    """A reviewer's decision: known, with a reason, evidence from the candidate's list only."""
    return issues(df, "judgement", F.col(key), [("unknown_decision", ~F.coalesce(F.col("decision").isin("accept", "reject", "repair"), F.lit(False))), ("no_reason", text.stripped(F.col("reason")) == ""), ("foreign_evidence", F.size(F.array_except("evidence_ids", allowed_evidence)) > 0), ("repair_without_value", (F.col("decision") == "repair") & F.col("final_value").isNull())])


def review_shards(expected: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Every item reviewed exactly once."""
    odd = joins.cover_once(expected, reviews, key)
    return odd.select(F.lit("review_shards").alias("check"), "code", F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))


def evidence_checker(df: DataFrame, key: str, evidence: Sequence[str]) -> DataFrame:
    blank = reduce(lambda a, b: a & b, [text.stripped(F.col(c)) == "" for c in evidence])
    return issues(df, "evidence", F.col(key), [("unsupported", blank)])


def claim_fact_checker(df: DataFrame, key: str) -> DataFrame:
    return issues(df, "claim_fact", F.col(key), [("claim_taken_for_fact", F.col("is_claim") & F.col("is_fact"))])


def roster_checker(df: DataFrame, key: str, roster: Column) -> DataFrame:
    return issues(df, "roster", F.col(key), [("unknown_source_pov", F.size(F.array_except("source_povs", roster)) > 0)])


def leakage_checker(df: DataFrame, key: str, body: str, hidden: str) -> DataFrame:
    return issues(df, "perspective_leakage", F.col(key), [("hidden_id_in_text", F.exists(hidden, lambda h: (h != "") & F.contains(F.col(body), h)))])


def gate(rules: Sequence[tuple[str, Column]]) -> Column:
    """struct(ok, reasons) of reason-coded rules."""
    reasons = codes(rules)
    return F.struct((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"))


def decision(*when: tuple[Column, str], default: str = "needs_review") -> Column:
    """The first decision whose condition holds."""
    out = F.lit(default)
    for cond, name in reversed(when):
        out = F.when(cond, name).otherwise(out)
    return out


def rejectable(found: Column, fatal: Sequence[str], prefixes: Sequence[str] = ()) -> Column:
    """Whether issue codes hold a fatal one, by name or prefix."""
    named = F.arrays_overlap(found, F.array(*[F.lit(f) for f in fatal])) if fatal else F.lit(False)
    return named | F.exists(found, lambda c: reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes], F.lit(False)))


def file_pairs(left: DataFrame, right: DataFrame, key: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Files of either side without the other."""
    parts = [coverage(right, "file_pairs", left, key, f"no_{names[1]}"), coverage(left, "file_pairs", right, key, f"no_{names[0]}")]
    return report(parts)


def blockers(df: DataFrame, key: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """What stands in the way of each key, and the first of it as the next action ("ready" without any)."""
    found = codes(rules)
    return df.select(*key, found.alias("blockers"), F.coalesce(F.get(found, 0), F.lit("ready")).alias("next_action"))
