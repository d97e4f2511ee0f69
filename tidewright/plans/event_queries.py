"""Queries over the `events` table as intervals on a session clock, each with a DuckDB twin.

An event lasts 30 + event_id % 90 seconds from its time; its user is the player whose view it comes from. Six neighbouring
users play in one game, so games follow from users and every event belongs to one.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import numbers
from tidewright.operators import aggregates, folds, joins, matching, selection, series, windows
from tidewright.plans import ledger, trajectory
from tidewright.scratch import shared_dir
from tidewright.session import table
from tidewright.streaming import ordered, twins

_START = datetime.datetime(2024, 1, 1)

EV = """ev AS (
    SELECT event_id, user_id, event_type, value, CAST(props->>'$.k' AS BIGINT) AS k,
           CAST(floor(epoch(ts) - 1704067200) AS DOUBLE) AS s,
           CAST(floor(epoch(ts) - 1704067200) AS DOUBLE) + 30 + event_id % 90 AS e
    FROM events)"""
GAMES = "gv AS (SELECT *, user_id // 6 AS game_id FROM ev), roster AS (SELECT DISTINCT game_id, user_id AS player_id FROM gv)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, k, s, e."""
    seconds = F.timestamp_diff("SECOND", F.lit(_START).cast("timestamp_ntz"), F.col("ts")).cast("double")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"), seconds.alias("s"))
    return rows.withColumn("e", F.col("s") + 30 + F.col("event_id") % 90)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`spans` with game_id."""
    return spans(spark, sf_dir).withColumn("game_id", F.floor(F.col("user_id") / 6))


def roster(ev: DataFrame) -> DataFrame:
    return ev.select("game_id", F.col("user_id").alias("player_id")).distinct()


def ledger_tables(ev: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, claims and players of the ledger, made of the events table: errors are claims, all else are world events.

    Every third event has a second viewer; signups happen in meetings; a tenth has public evidence. Half of the claims are
    heard by the whole table. What claims say turns on `k`.
    """
    me, next_ = F.col("user_id"), F.col("game_id") * 6 + (F.col("user_id") + 1) % 6
    sure = F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("certainty")
    none = F.array().cast("array<string>")
    span = [F.col("s").alias("abs_start_sec"), F.col("e").alias("abs_end_sec"), sure]
    events = ev.where("event_type <> 'error'").select(
        "game_id", F.format_string("ge_%08d", "event_id").alias("world_event_id"), *span, F.when(F.col("k") % 3 == 0, F.array(me, next_)).otherwise(F.array(me)).alias("source_povs"),
        F.when(F.col("event_type") == "signup", "meeting").otherwise("gameplay").alias("phase_type"), F.when(F.col("k") % 10 == 0, F.array(F.lit("board"))).otherwise(none).alias("public_evidence"),
        "event_type", F.array(me).alias("actors"), F.concat(F.lit("room"), F.col("k") % 7).alias("location"), F.concat(F.when(F.col("k") % 5 == 0, "杀 ").otherwise(""), F.col("event_type")).alias("description"),
    )
    table_of_six = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("game_id") * 6 + i)
    said = F.when(F.col("k") % 4 == 0, "我没有杀人").when(F.col("k") % 4 == 1, F.concat(F.lit("seen in room"), F.col("k") % 7)).when(F.col("k") % 4 == 2, "投票").otherwise("...")
    claims = ev.where("event_type = 'error'").select(
        "game_id", F.format_string("claim_%08d", "event_id").alias("claim_id"), *span, me.alias("speaker"), F.when(F.col("k") % 2 == 0, table_of_six).otherwise(F.array(me)).alias("heard_by"),
        said.alias("content"), said.alias("normalized_content"), F.array(next_).alias("target_entities"),
    )
    return events, claims, roster(ev)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.visibility_edges(*ledger_tables(games(spark, sf_dir)))


def visibility_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("edge_id", "event_id", "player_id", "visibility", "confidence", F.size("evidence_ids").cast("bigint").alias("n_evidence"))


def visibility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("player_id", "visibility").agg(F.count("*").alias("n_edges"), numbers.exact_mean(F.col("confidence")).alias("mean_confidence"))


def claim_event_range_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, claims, players = ledger_tables(games(spark, sf_dir))
    links = ledger.claim_truth_links(claims, events, ledger.visibility_edges(events, claims, players), players, within=1800.0)
    aware = F.array_join(F.transform(F.array_sort(F.map_entries("local_awareness_by_player")), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"])), ",")
    return links.select("claim_id", F.array_join("world_event_ids", ",").alias("world_event_ids"), "truth_status_global", "confidence", "needs_human_review", aware.alias("awareness"))


def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    snaps = ev.where("event_type = 'purchase'").select("user_id", F.col("s").alias("snap_s"), F.col("event_id").alias("snap_id"), F.round("value", 2).alias("snap_value"))
    asks = ev.where("event_type = 'error'").select("event_id", "user_id", "s")
    return joins.asof_join(asks, snaps, "s", "snap_s", ["user_id"], order=["snap_id"]).select("event_id", "user_id", "s", "snap_id", "snap_s", "snap_value")


def nearest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    points = ev.where("event_type = 'click'").select("event_id", "user_id", "s")
    views = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("s").alias("vs"), F.col("e").alias("ve"))
    found = joins.nearest_interval(points, views, "s", ("vs", "ve"), ["user_id"], "event_id", ["view_id"])
    return found.select("event_id", "user_id", "distance")


def containment_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    kids = ev.where("event_type = 'click'").select("event_id", F.col("s").alias("cs"), (F.col("s") + 5).alias("ce"))
    big = ev.where("event_type = 'view'").select(F.col("event_id").alias("parent_id"), F.col("s").alias("ps"), (F.col("e") + 600).alias("pe"))
    return joins.containment_join(kids, big, ("cs", "ce"), ("ps", "pe"), [], "event_id", "parent_id", [F.col("pe") - F.col("ps")]).select("event_id", "parent_id")


def place_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest span of the same game that each event's start lies in, its end left out; wide spans lie over all of a day."""
    ev = games(spark, sf_dir)
    wide = F.when(F.col("k") % 10 == 0, 86400.0).when(F.col("k") % 3 == 0, 3600.0).otherwise(60.0)
    held = ev.where("event_type <> 'click'").select("game_id", F.col("event_id").alias("span_id"), F.col("s").alias("ps"), (F.col("s") + wide).alias("pe")).withColumn("length", F.col("pe") - F.col("ps"))
    points = ev.select("game_id", "event_id", (F.col("s") + 60).alias("at"))
    return joins.point_in_interval(points, held, "at", ("ps", "pe"), ["game_id"], "event_id", "span_id", ["length"]).select("event_id", "span_id")


def band_join_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    said = ev.where("event_type = 'view'").select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("speaker"), F.col("e").alias("claim_end"))
    reply = ev.where("event_type = 'purchase'").select("event_id", "user_id", F.col("s").alias("reply_start"))
    met = joins.band_join(said, reply, "claim_end", "reply_start", 5, 300).where("speaker <> user_id")
    return met.select("claim_id", F.col("event_id").alias("reply_id"), "gap")


def chain_cluster_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    found = windows.consensus(ev, "event_type", "s", "user_id", "event_id", tolerance=900, least=2)
    return found.select("event_type", F.col("abs_sec").alias("abs_sec"), F.size("source_povs").cast("bigint").alias("n_users"), F.col("index").cast("bigint").alias("boundary_index"), F.size("evidence_ids").cast("bigint").alias("n_events"))


def phase_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    ordered = ev.withColumn("ord", F.col("s") + F.col("event_id") / 1e7)
    runs = windows.islands(ordered, ["user_id"], "ord", "event_type", "e")
    return runs.select("user_id", "event_type", F.floor("start_sec").cast("double").alias("start_sec"), "end_sec", "n_rows")


def phase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).where("event_type in ('view', 'purchase')").groupBy("user_id", "s").agg(F.min("event_type").alias("event_type"))
    state = F.when(F.col("event_type") == "view", "gameplay").otherwise("meeting")
    found = windows.phases(ev.withColumn("stop", F.lit(2_592_000.0)), ["user_id"], "s", state, "stop")
    return found.select("user_id", F.col("phase_index").cast("bigint").alias("phase_index"), "phase_type", "abs_start_sec", "abs_end_sec")


def episode_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).groupBy("user_id", "s").agg(F.min("event_type").alias("event_type"))
    found = windows.episodes(ev, ["user_id"], "event_type", "s", ["signup"], ["error"], F.lit(2_592_000.0))
    return found.select("user_id", F.col("episode_index").cast("bigint").alias("episode_index"), "abs_start_sec", "abs_end_sec")


def phase_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    cut = F.array(F.struct((F.col("s") + 20).alias("start"), (F.col("s") + 35).alias("end")), F.struct((F.col("s") + 60).alias("start"), (F.col("s") + 61).alias("end")))
    found = windows.phase_chunks(ev, "s", "e", cut, 15.0)
    return found.select("event_id", "start_sec", "end_sec")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).withColumn("stop", F.col("s") + 40 + F.col("event_id") % 300)
    found = windows.sliding(ev, "s", "stop", 90.0, 10.0)
    return found.select("event_id", F.col("window").cast("bigint").alias("window_no"), "start_sec", "end_sec")


def trajectory_nodes(ev: DataFrame, *more: Column) -> DataFrame:
    """Trajectory nodes made of the events table, and `more`: errors are heard, by a neighbour too where k % 3 = 0; signups are public."""
    none, audio = F.array().cast("array<bigint>"), F.col("event_type") == "error"
    return ev.select(
        F.col("game_id").alias("episode_id"), F.format_string("n%08d", "event_id").alias("trajectory_node_id"), F.col("s").alias("abs_start_sec"), F.col("e").alias("abs_end_sec"), F.array("user_id").alias("source_povs"),
        (F.col("event_type") == "signup").alias("public_ui"), (F.col("k") % 5 == 0).alias("global_fact"), F.when(audio, "audio").otherwise("visual").alias("modality"), F.lit(None).cast("string").alias("utterance"),
        F.when(audio & (F.col("k") % 3 == 0), F.array(F.col("game_id") * 6 + (F.col("user_id") + 1) % 6)).otherwise(none).alias("heard_by"), (F.col("k") % 2 == 0).alias("audio_admissible"), F.array(F.format_string("ev%d", F.col("event_id") % 50)).alias("evidence_asset_ids"), *more,
    )


def cutoff_information_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each player of a game can know at the end of its last event of each day."""
    ev = games(spark, sf_dir)
    cutoffs = ev.groupBy("game_id", F.floor(F.col("s") / 86400)).agg(F.max("e").alias("cutoff_abs_sec")).select(F.col("game_id").alias("episode_id"), "cutoff_abs_sec")
    players = roster(ev).withColumnRenamed("game_id", "episode_id")
    found = trajectory.information_states(trajectory_nodes(ev), players, cutoffs)
    n = lambda c: F.size(c).cast("bigint")
    return found.select("information_state_id", "player_id", "cutoff_abs_sec", F.array_join("known_facts", ",").alias("known_facts"), n("private_observations").alias("n_private"), n("public_history").alias("n_public"), n("heard_claims").alias("n_heard"), n("forbidden_events").alias("n_forbidden"), n("available_evidence_ids").alias("n_evidence"))


_TYPES = {"click": "movement", "view": "task", "purchase": "vote", "error": "claim", "signup": "meeting"}


def _daily_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with who is seen, named and speaking in them, the players, and the end of each day."""
    ev = games(spark, sf_dir)
    beside, across = (F.col("game_id") * 6 + (F.col("user_id") + n) % 6 for n in (1, 2))
    none, kind = F.array().cast("array<bigint>"), F.lit("meeting")
    for name, as_type in _TYPES.items():
        kind = F.when(F.col("event_type") == name, as_type).otherwise(kind)
    nodes = trajectory_nodes(
        ev, F.col("user_id").alias("player_id"), kind.alias("event_type"), F.when(F.col("k") % 4 == 0, F.array(beside)).otherwise(none).alias("visible_players"),
        F.when(F.col("k") % 7 < 2, F.array(across)).otherwise(none).alias("mentioned_players"), F.when(F.col("event_type") == "error", F.col("user_id")).alias("speaker_id"), F.lit("x").alias("location"),
    )
    cutoffs = ev.groupBy("game_id", F.floor(F.col("s") / 86400)).agg(F.max("e").alias("cutoff_abs_sec")).select(F.col("game_id").alias("episode_id"), "cutoff_abs_sec")
    return nodes, roster(ev).withColumnRenamed("game_id", "episode_id"), cutoffs


def layer_evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a player can hold about another in each layer, at the end of each day."""
    nodes, players, cutoffs = _daily_nodes(spark, sf_dir)
    found = trajectory.layer_evidence(trajectory.state_keys(players, cutoffs), nodes, players)
    return found.select("information_state_id", "subject", "target", "layer", F.array_join("evidence_ids", ",").alias("evidence_ids"))


def tom_trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial variants where the subject has evidence that the target lacks."""
    nodes, players, cutoffs = _daily_nodes(spark, sf_dir)
    evidence = trajectory.layer_evidence(trajectory.state_keys(players, cutoffs), nodes, players)
    found = trajectory.trials(evidence, trajectory.evidence_states(nodes, players, cutoffs))
    return found.select("trial_id", "variant", F.array_join("evidence_ids", ",").alias("evidence_ids"), "split")


def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    items = ev.where("event_type in ('view', 'click')").select("user_id", "s", F.format_string("%09d", "event_id").alias("item"))
    cuts = ev.where("event_type = 'error'").select("user_id", "event_id", F.col("s").alias("cutoff"))
    found = windows.last_n_at(cuts, items, ["user_id"], "cutoff", "s", "item", 5, "history")
    return found.select("event_id", F.array_join("history", ",").alias("history"))


def phase_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).withColumn("ord", F.struct("s", "event_id"))
    found = windows.enrich_phases(ev, ["user_id"], "event_type", "ord", "event_id")
    return found.select("event_id", F.col("phase_index").cast("bigint").alias("phase_index"), F.col("round_in_kind").cast("bigint").alias("round_in_kind"), "previous_phase_id", "next_phase_id")


def previous_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).withColumn("state", F.when(F.col("event_type") == "purchase", F.round("value", 2)))
    return joins.previous_state(ev, ["user_id"], ["s", "event_id"], "state").select("event_id", "previous")


def weighted_vote_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir).withColumns({"e": F.col("e") + 1800, "w": (F.col("k") % 8) / 8})
    found = windows.vote_ticks(ev, ["game_id"], "event_type", F.col("w"), ("s", "e"), 3600.0, ["s", "event_id"])
    return found.select("game_id", F.col("tick").cast("bigint").alias("tick"), "event_type", "share")


def next_within_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    asks = ev.where("event_type = 'purchase'").select("event_id", "user_id", F.col("e").alias("cutoff"))
    later = ev.select(F.col("event_id").alias("next_id"), F.col("user_id").alias("next_user"), F.col("s").alias("next_s"))
    found = joins.next_other(asks, later, "cutoff", "next_s", "user_id", "next_user", 600.0, order=["next_id"])
    return found.select("event_id", "next_id")


def uniform_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).withColumn("grp", F.col("user_id"))
    fixed = ev.where("event_id < 50").withColumns({"grp": -1 - F.col("event_id") % 5, "s": F.floor(F.col("event_id") / 5) * 30.0}).withColumn("e", F.col("s") + 10)
    return windows.uniform_grid(ev.unionByName(fixed), ["grp"], "s", "e")


def first_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.entry_bounds(spans(spark, sf_dir), ["user_id"], "s", "event_type", "view", "purchase")


def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    each = ev.select("event_id", F.explode(windows.sample_times(F.col("s"), F.col("e"), F.lit(0.125))).alias("at"))
    return each.groupBy("event_id").agg(F.count("*").alias("n_samples"), F.max("at").alias("last_at"), F.sum("at").alias("sum_at"))


def timed_event_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    m = F.col("event_id") % 8
    ls = F.when(m == 0, F.lit(5.0)).when(m == 1, F.col("s") + 2).when(m == 2, F.lit(20.0)).when(m == 3, F.lit(7.0)).when(m == 4, F.lit(-50.0)).when(m == 5, F.col("e") + 500).when(m == 6, F.lit(0.0))
    le = F.when(m == 0, F.lit(9.0)).when(m == 1, F.col("s") + 9).when(m == 2, F.lit(10.0)).when(m == 3, F.lit(7.0)).when(m == 4, F.lit(3.0)).when(m == 5, F.col("e") + 600).when(m == 6, F.col("e") - F.col("s"))
    out = numbers.repair_timed_events(ev.withColumns({"ls": ls, "le": le}), "ls", "le", "s", "e")
    return out.select("event_id", "ok", "reason", "abs_start", "abs_end")


def affine_fit_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).withColumn("raw", F.col("s") * 1.001 + 5 + F.col("k") % 3)
    fit = aggregates.least_squares(ev, ["user_id"], "s", "raw")
    return fit.select("user_id", "n", F.round("scale", 6).alias("scale"), F.round("median_residual", 4).alias("median_residual"), F.round("p95_residual", 4).alias("p95_residual"))


def stratified_quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir)
    kinds = ["purchase", "error", "signup", "view", "click"]
    shares = {"purchase": 0.1, "error": 0.35, "signup": 0.15, "view": 0.15, "click": 0.1}
    return selection.quota_then_fill(ev, "event_type", kinds, shares, 100, ["s", "event_id"], ["event_type", "k"]).select("event_id", "event_type", "k")


def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.keep_first(spans(spark, sf_dir), ["user_id", "k"], ["s", "event_id"]).select("event_id", "user_id", "k")


def latest_attempt_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).withColumns({"task_key": F.concat_ws("|", F.col("user_id").cast("string"), (F.col("k") % 5).cast("string")), "status": F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").otherwise("ok")})
    return selection.latest_attempt(ev, "task_key", "status", "event_id").select("task_key", "event_id", "status")


def index_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.index_gaps(spans(spark, sf_dir).select("user_id", "k").distinct(), ["user_id"], "k").select("user_id", "k")


def sliced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.slice_rows(spans(spark, sf_dir).where("event_type = 'click'"), ["s", "event_id"], skip=3, stride=7, limit=50).select("event_id", "s")


def safe_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of few values made unique within each game; some are given in the form of names that are made."""
    ev = games(spark, sf_dir)
    given = F.concat(F.lit("ge_"), (F.col("k") % 3).cast("string"), F.when(F.col("k") % 7 == 0, F.concat(F.lit("_"), "event_type")).when(F.col("k") % 11 == 0, "_click_2").otherwise(""))
    return selection.safe_ids(ev.select("game_id", "event_id", "s", given.alias("safe_id"), "event_type"), "safe_id", ["s", "event_id"], "event_type", ["game_id"]).select("event_id", "safe_id")


def row_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = selection.shards(spans(spark, sf_dir), ["s", "event_id"], 64)
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"))


def eval_metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).withColumns({"status": F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").otherwise("ok"), "track": (F.col("user_id") % 4), "probe": F.when(F.col("k") % 9 == 0, "").otherwise((F.col("k") % 3).cast("string"))})
    from tidewright.plans.scoring import basic_metrics

    return basic_metrics(ev.withColumns({"parse_ok": F.col("k") % 2 == 0, "schema_ok": F.when(F.col("k") % 5 != 0, F.col("k") % 3 == 0), "latency_sec": F.col("value")}), ["track"], "probe")


def greedy_interval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).withColumn("e", F.col("e") + 3600)
    return folds.merge_events(ev, ["event_type"], "s", "e", "event_id", ["s", "event_id"], edge_sec=60)


def claim_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.merge_claims(spans(spark, sf_dir), ["event_type"], "s", "event_id", ["s", "event_id"], within=900)


def anchor_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fuse_by_anchor(spans(spark, sf_dir), ["event_type"], "s", "event_id", ["s", "event_id"], tolerance=1200)


def matching_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the hourly counts of errors of five days fit those of each kind of event best."""
    ev = spans(spark, sf_dir)
    hour = F.floor(F.col("s") / 3600)
    counts = ev.groupBy("event_type", hour.alias("at")).agg(F.count("*").alias("value"))
    piece = ev.where("event_type = 'error' and s >= 864000 and s < 1296000").groupBy((hour - 240).alias("at")).agg(F.count("*").alias("value"))
    kinds = counts.select("event_type").distinct()
    return series.correlate(counts, joins.grid(piece, kinds), ["event_type"], size=64).select("event_type", "position", F.round("score", 6).alias("score"))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clips of a game: player, label, length and number within the player's."""
    numbered = F.row_number().over(Window.partitionBy("player_id").orderBy("s", "event_id"))
    return games(spark, sf_dir).select("game_id", F.col("user_id").alias("player_id"), F.col("event_type").alias("label"), (F.col("e") - F.col("s")).alias("duration"), "s", "event_id").withColumn("idx", numbered)


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clips of players other than their game's anchor (most clips, then the smaller player), the anchor's, and the matches."""
    clips = _clips(spark, sf_dir)
    sizes = clips.groupBy("game_id", "player_id").agg(F.count("*").alias("n"))
    anchor = joins.first_per(sizes, ["game_id"], [F.desc("n"), "player_id"]).select("game_id", F.col("player_id").alias("anchor_id"))
    rows = clips.join(anchor, "game_id")
    others, anchors = rows.where("player_id <> anchor_id").drop("anchor_id"), rows.where("player_id = anchor_id").drop("anchor_id")
    return others, anchors, matching.match_to_anchor(others, anchors, "player_id", "label", "duration", "idx", 15.0, on=["game_id"])


def anchor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[2]


def leftover_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    others, _, found = _matched(spark, sf_dir)
    rest = others.join(found, ["game_id", "player_id", "idx"], "left_anti")
    return matching.cluster_leftovers(rest, "player_id", "label", "duration", "idx", 15.0, 2, on=["game_id"])


def smooth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).withColumn("label", F.when(F.col("k") % 11 == 0, "unknown").when(F.col("k") % 4 == 0, "meeting").otherwise("gameplay"))
    return folds.smooth_runs(ev, ["user_id"], "event_id", "label", 3)


def boundary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.boundary_scan(spans(spark, sf_dir), "user_id", "s", "event_type", ["signup", "view"], ["error", "purchase"])


def stream_boundary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same episodes by a stream: six batches by time of eight files each, where a tenth of each batch's rows come one batch late, and a last row that closes."""
    root = f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}"
    late = (F.col("event_id") % 10 == 0).cast("int")
    ev = spans(spark, sf_dir).select("user_id", F.timestamp_seconds("s").alias("ts"), "s", "event_type", (F.floor(F.col("s") / 518400) + late).alias("file"))
    last = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(4e9)).alias("ts"), F.lit(0.0).alias("s"), F.lit("click").alias("event_type"))
    for i in range(6):
        ev.where(F.col("file") == i if i < 5 else F.col("file") >= i).drop("file").repartition(8, "user_id").write.parquet(f"{root}/in/{i}")
    last.write.parquet(f"{root}/in/6")
    found = ordered.boundary_scan(twins.read_events(spark, f"{root}/in/*", last.schema, 8), "user_id", "ts", "s", "event_type", ["signup", "view"], ["error", "purchase"], "12 days")
    return twins.run_to_table(found, f"{root}/table", f"{root}/checkpoint")


def affine_fit_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spans(spark, sf_dir).withColumn("raw", F.col("s") * 1.001 + 5 + F.when(F.col("k") % 7 == 0, 40).otherwise(F.col("k") % 3))
    return folds.affine_fit(ev, "user_id", "s", "raw", "event_id")


QUERIES = {f.__name__: f for f in (
    visibility_edges, visibility_summary, claim_event_range_links, asof_snapshot, nearest_interval, containment_parent, place_of_events, band_join_reaction,
    chain_cluster_consensus, phase_islands, phase_split, episode_build, phase_chunks, sliding_windows, cutoff_information_state, layer_evidence_rows, tom_trial_rows, last_n_history,
    phase_enrich, previous_state, weighted_vote_tick, next_within_horizon, uniform_grid, first_state, sample_times, timed_event_repair,
    affine_fit_least_squares, stratified_quota_topk, keep_first_dedupe, latest_attempt_dedupe, index_gaps, sliced_rows, safe_event_ids, row_shards,
    eval_metrics_rollup, greedy_interval_dedup, claim_dedup, anchor_fusion, anchor_matches, leftover_clusters, matching_hours, smooth_runs, boundary_scan, stream_boundary_scan, affine_fit_ransac,
)}

_EDGES = f"""WITH {EV}, {GAMES},
    facts AS (SELECT game_id, printf('ge_%08d', event_id) AS event_id, CASE WHEN k % 3 = 0 THEN [user_id, game_id * 6 + (user_id + 1) % 6] ELSE [user_id] END AS povs, event_type = 'signup' OR k % 10 = 0 AS public,
        round(least(value / 100, 1.0), 6) AS sure, s, e, user_id, k, event_type FROM gv WHERE event_type <> 'error'),
    claims AS (SELECT game_id, printf('claim_%08d', event_id) AS event_id, CASE WHEN k % 2 = 0 THEN list_transform(range(0, 6), lambda i: game_id * 6 + i) ELSE [user_id] END AS heard,
        round(least(value / 100, 1.0), 6) AS sure, s, e, user_id, k FROM gv WHERE event_type = 'error'),
    edges AS (
        SELECT event_id, player_id, CASE WHEN list_contains(povs, player_id) THEN 'direct_visual' WHEN public THEN 'public_ui' ELSE 'not_visible' END AS visibility,
            CASE WHEN list_contains(povs, player_id) THEN sure WHEN public THEN least(0.8, sure) ELSE 0.75 END AS confidence FROM facts JOIN roster USING (game_id)
        UNION ALL SELECT event_id, player_id, CASE WHEN list_contains(heard, player_id) THEN 'heard_claim' ELSE 'not_visible' END, sure FROM claims JOIN roster USING (game_id))"""

LINKS = _EDGES + """, said AS (SELECT *, CASE k % 4 WHEN 0 THEN '我没有杀人' WHEN 1 THEN 'seeninroom' || (k % 7) WHEN 2 THEN '投票' ELSE '...' END AS t FROM claims),
        near AS (SELECT c.game_id, c.event_id AS claim_id, c.user_id AS speaker, c.heard, c.sure AS cs, f.sure AS fs, c.k AS ck, f.event_id, f.user_id AS actor, row_number() OVER (PARTITION BY c.event_id ORDER BY f.event_id) AS rn
            FROM said c JOIN facts f ON c.game_id = f.game_id AND f.s <= c.e + 1800 AND f.e >= c.s - 1800
             AND (f.user_id = c.user_id OR f.user_id = c.game_id * 6 + (c.user_id + 1) % 6 OR contains(c.t, 'room' || (f.k % 7)) OR (c.k % 4 = 0 AND f.k % 5 = 0))),
        g AS (SELECT game_id, claim_id, any_value(heard) AS heard, string_agg(event_id, ',' ORDER BY event_id) AS world_event_ids, list(event_id) AS ids, any_value(ck) AS ck, bool_or(actor = speaker) AS acts, least(any_value(cs), max(fs)) AS confidence FROM near WHERE rn <= 4 GROUP BY game_id, claim_id),
        t AS (SELECT *, CASE WHEN acts AND ck % 4 = 0 THEN 'contradicted' WHEN acts THEN 'supported' ELSE 'unverified' END AS truth_status_global FROM g)"""

_DAYS = f"""WITH {EV}, {GAMES}, c AS (SELECT game_id, max(e) AS cutoff FROM gv GROUP BY game_id, floor(s / 86400)),
    p AS (SELECT r.game_id, r.player_id, cutoff, event_id, CASE WHEN s > cutoff THEN 'post_cutoff' WHEN event_type = 'signup' THEN 'public_ui' WHEN user_id = r.player_id AND event_type = 'error' THEN 'direct_audio' WHEN user_id = r.player_id THEN 'direct_visual'
        WHEN event_type = 'error' AND k % 3 = 0 AND r.player_id = r.game_id * 6 + (user_id + 1) % 6 AND k % 2 = 0 THEN 'heard_claim' WHEN k % 5 = 0 THEN 'not_visible' ELSE 'unknown' END AS a
        FROM roster r JOIN c USING (game_id) JOIN gv USING (game_id)),
    q AS (SELECT *, a IN ('direct_visual', 'direct_audio', 'public_ui', 'heard_claim') AS known FROM p)"""

_FROM_FIRST = f"""WITH RECURSIVE {EV}, t AS (SELECT DISTINCT event_type, s FROM ev),
    nxt AS (SELECT event_type, s, min(s) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN {{within}}.5 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM t),
    f AS (SELECT event_type, min(s) AS s FROM t GROUP BY event_type UNION ALL SELECT f.event_type, n FROM f JOIN nxt USING (event_type, s) WHERE n IS NOT NULL),
    k AS (SELECT f.event_type, f.s, min(event_id) AS kept_id FROM f JOIN ev USING (event_type, s) GROUP BY f.event_type, f.s)
    SELECT event_id, last_value(k.kept_id IGNORE NULLS) OVER (PARTITION BY ev.event_type ORDER BY ev.s RANGE UNBOUNDED PRECEDING) AS kept_id FROM ev LEFT JOIN k USING (event_type, s)"""

_MATCHES = f"""WITH RECURSIVE {EV}, {GAMES}, c AS (SELECT game_id, user_id AS player_id, event_type AS label, e - s AS duration, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS idx FROM gv),
    a AS (SELECT game_id, arg_min(player_id, struct_pack(n := -n, p := player_id)) AS anchor_id FROM (SELECT game_id, player_id, count(*) AS n FROM c GROUP BY ALL) GROUP BY game_id),
    p AS (SELECT x.game_id, x.player_id, x.idx, y.idx AS anchor_idx, row_number() OVER (PARTITION BY x.player_id ORDER BY abs(x.duration - y.duration), abs(x.idx - y.idx), x.idx, y.idx) AS n
        FROM c x JOIN a USING (game_id) JOIN c y ON y.game_id = x.game_id AND y.player_id = anchor_id AND y.label = x.label AND abs(x.duration - y.duration) <= 15 WHERE x.player_id <> anchor_id),
    t AS (SELECT player_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS mine, CAST([] AS BIGINT[]) AS theirs FROM p GROUP BY player_id
        UNION ALL SELECT t.player_id, p.n, CASE WHEN list_contains(mine, idx) OR list_contains(theirs, anchor_idx) THEN mine ELSE list_append(mine, idx) END,
            CASE WHEN list_contains(mine, idx) OR list_contains(theirs, anchor_idx) THEN theirs ELSE list_append(theirs, anchor_idx) END FROM t JOIN p ON p.player_id = t.player_id AND p.n = t.n + 1),
    m AS (SELECT game_id, player_id, unnest(mine) AS idx, unnest(theirs) AS anchor_idx FROM (SELECT player_id, arg_max(mine, n) AS mine, arg_max(theirs, n) AS theirs FROM t GROUP BY player_id) JOIN (SELECT DISTINCT game_id, player_id FROM c) USING (player_id))"""

_LAYER_TYPES = " UNION ALL ".join(f"SELECT '{layer}' AS layer, '{name}' AS event_type" for layer, types in trajectory.LAYERS.items() for name, as_type in _TYPES.items() if as_type in types)
_LAYERS = _DAYS + f""", av AS (SELECT DISTINCT game_id, player_id, cutoff, 'ev' || (event_id % 50) AS ev FROM q WHERE known),
    about AS (SELECT DISTINCT game_id, event_id, s, layer, t AS target FROM (
        SELECT game_id, event_id, s, event_type, CASE WHEN k % 4 = 0 THEN game_id * 6 + (user_id + 1) % 6 END AS t FROM gv UNION ALL SELECT game_id, event_id, s, event_type, CASE WHEN k % 7 < 2 THEN game_id * 6 + (user_id + 2) % 6 END FROM gv
        UNION ALL SELECT game_id, event_id, s, event_type, CASE WHEN event_type IN ('error', 'click', 'view') THEN user_id END FROM gv) JOIN ({_LAYER_TYPES}) USING (event_type) JOIN roster r USING (game_id) WHERE t = r.player_id),
    le AS (SELECT av.game_id, av.player_id AS subject, cutoff, target, layer, list_sort(list(DISTINCT ev)) AS evs FROM av JOIN about ON about.game_id = av.game_id AND about.s <= cutoff AND 'ev' || (about.event_id % 50) = ev AND target <> av.player_id GROUP BY ALL)"""

ORACLE_SQL = {
    "layer_evidence_rows": _LAYERS + " SELECT game_id || ':' || subject || ':' || printf('%.3f', cutoff) AS information_state_id, subject, target, layer, array_to_string(evs, ',') AS evidence_ids FROM le",
    "tom_trial_rows": _LAYERS + """, th AS (SELECT game_id, player_id AS target, cutoff, list(ev) AS theirs FROM av GROUP BY ALL),
        lo AS (SELECT game_id || ':' || subject || ':' || printf('%.3f', cutoff) || ':' || target || ':' || layer AS g, list_sort(list_filter(evs[1:4], lambda x: NOT list_contains(coalesce(theirs, []), x))) AS evs FROM le LEFT JOIN th USING (game_id, target, cutoff))
        SELECT g || ':' || v AS trial_id, v AS variant, array_to_string(evs, ',') AS evidence_ids, CASE WHEN h < 7 THEN 'train' WHEN h < 9 THEN 'dev' ELSE 'test' END AS split
        FROM (SELECT *, CAST('0x' || substr(sha256(g), 1, 8) AS UBIGINT) % 10 AS h FROM lo WHERE len(evs) > 0), (SELECT unnest(['A', 'B', 'C', 'D']) AS v)""",
    "matching_hours": f"""WITH {EV}, c AS (SELECT event_type, CAST(floor(s / 3600) AS BIGINT) AS h, count(*) AS v FROM ev GROUP BY ALL), n AS (SELECT event_type, max(h) + 1 AS n FROM c GROUP BY event_type),
        q AS (SELECT h - 240 AS j, v AS w FROM c WHERE event_type = 'error' AND h >= 240 AND h < 360), m AS (SELECT max(j) + 1 AS m, sqrt(sum(w * w)) AS norm FROM q),
        p AS (SELECT c.event_type, h - j AS position, sum(v * w) AS total FROM c, q, n, m WHERE n.event_type = c.event_type AND h - j BETWEEN 0 AND n - m GROUP BY c.event_type, h - j),
        b AS (SELECT event_type, arg_max(position, struct_pack(t := total, p := -position)) AS position, max(total) AS total FROM p GROUP BY event_type)
        SELECT b.event_type, b.position, round(any_value(total) / (sqrt(sum(v * v)) * any_value(norm)), 6) AS score FROM b, c, m WHERE c.event_type = b.event_type AND h >= b.position AND h < b.position + m GROUP BY b.event_type, b.position""",
    "anchor_matches": _MATCHES + " SELECT * FROM m",
    "leftover_clusters": _MATCHES + """, r AS (SELECT c.*, row_number() OVER (PARTITION BY c.game_id, label ORDER BY c.player_id, c.idx) AS k FROM c JOIN a USING (game_id) LEFT JOIN m USING (game_id, player_id, idx) WHERE player_id <> anchor_id AND anchor_idx IS NULL),
        every AS (SELECT game_id, label, list(struct_pack(k := k, p := player_id, d := duration)) AS items FROM r GROUP BY game_id, label),
        f AS (SELECT game_id, label, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS took FROM every
            UNION ALL SELECT game_id, label, k, CASE WHEN len(near) > 0 THEN list_concat(used, near, [k]) ELSE used END, CASE WHEN len(near) > 0 THEN list_append(near, k) ELSE CAST([] AS BIGINT[]) END
                FROM (SELECT r.game_id, r.label, r.k, f.used, CASE WHEN list_contains(f.used, r.k) THEN CAST([] AS BIGINT[]) ELSE list_transform(list_filter(items, lambda x: x.p <> r.player_id AND abs(x.d - r.duration) <= 15 AND NOT list_contains(f.used, x.k)), lambda x: x.k) END AS near
                    FROM f JOIN r ON r.game_id = f.game_id AND r.label = f.label AND r.k = f.k + 1 JOIN every ON every.game_id = f.game_id AND every.label = f.label)),
        g AS (SELECT game_id, label, k AS seed, unnest(took) AS k FROM f)
        SELECT g.game_id, g.label, x.player_id, x.idx, y.player_id AS seed_player_id, y.idx AS seed_idx FROM g JOIN r x ON x.game_id = g.game_id AND x.label = g.label AND x.k = g.k JOIN r y ON y.game_id = g.game_id AND y.label = g.label AND y.k = g.seed""",
    "visibility_edges": _EDGES + " SELECT 'vis_' || event_id || '_' || player_id AS edge_id, event_id, player_id, visibility, confidence, CAST(visibility <> 'not_visible' AS BIGINT) AS n_evidence FROM edges",
    "visibility_summary": _EDGES + " SELECT player_id, visibility, count(*) AS n_edges, (2 * sum(CAST(round(confidence * 1000000) AS BIGINT)) + count(*)) // (2 * count(*)) / 1000000 AS mean_confidence FROM edges GROUP BY ALL",
    "claim_event_range_links": LINKS + """,
        w AS (SELECT claim_id, list(DISTINCT player_id) AS saw FROM (SELECT claim_id, unnest(ids) AS event_id FROM t) u JOIN edges USING (event_id) WHERE visibility = 'direct_visual' GROUP BY claim_id),
        a AS (SELECT t.claim_id, string_agg(player_id || ':' || CASE WHEN list_contains(saw, player_id) THEN CASE WHEN truth_status_global = 'contradicted' THEN 'has_contradictory_visual_evidence' ELSE 'has_supporting_visual_evidence' END
            WHEN list_contains(heard, player_id) THEN 'not_enough_information' ELSE 'unknown' END, ',' ORDER BY player_id) AS awareness FROM t JOIN roster USING (game_id) LEFT JOIN w ON w.claim_id = t.claim_id GROUP BY t.claim_id)
        SELECT claim_id, world_event_ids, truth_status_global, confidence, truth_status_global = 'unverified' AS needs_human_review, awareness FROM t JOIN a USING (claim_id)""",
    "cutoff_information_state": _DAYS + """ SELECT game_id || ':' || player_id || ':' || printf('%.3f', cutoff) AS information_state_id, player_id, cutoff AS cutoff_abs_sec, coalesce(string_agg(printf('n%08d', event_id), ',' ORDER BY event_id) FILTER (known), '') AS known_facts,
        count(*) FILTER (known AND a <> 'public_ui') AS n_private, count(*) FILTER (a = 'public_ui') AS n_public, count(*) FILTER (a = 'heard_claim') AS n_heard, count(*) FILTER (NOT known) AS n_forbidden, count(DISTINCT event_id % 50) FILTER (known) AS n_evidence FROM q GROUP BY game_id, player_id, cutoff""",
    "greedy_interval_dedup": f"""WITH RECURSIVE {EV}, r AS (SELECT event_type, event_id, s, e + 3600 AS e, row_number() OVER (PARTITION BY event_type ORDER BY s, event_id) AS n FROM ev),
        f AS (SELECT event_type, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(lo DOUBLE, hi DOUBLE, id BIGINT)[]) AS live, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS kept_id FROM r GROUP BY event_type
            UNION ALL SELECT event_type, n, CASE WHEN hit > 0 THEN list_transform(l, lambda x, i: CASE WHEN i = hit THEN struct_pack(lo := least(x.lo, s), hi := greatest(x.hi, e), id := x.id) ELSE x END)
                ELSE list_append(l, struct_pack(lo := s, hi := e, id := event_id)) END, event_id, CASE WHEN hit > 0 THEN l[hit].id ELSE event_id END
                FROM (SELECT *, coalesce(list_position(list_transform(l, lambda x: (abs(x.lo - s) <= 60 AND abs(x.hi - e) <= 60) OR (least(x.hi, e) - greatest(x.lo, s)) / (greatest(x.hi, e) - least(x.lo, s)) > 0.5), true), 0) AS hit
                    FROM (SELECT r.*, list_filter(f.live, lambda x: x.hi > r.s OR x.lo >= r.s - 60) AS l FROM f JOIN r ON r.event_type = f.event_type AND r.n = f.n + 1)))
        SELECT event_id, kept_id FROM f WHERE n > 0""",
    "claim_dedup": _FROM_FIRST.format(within=900),
    "smooth_runs": f"""WITH {EV}, l AS (SELECT user_id, event_id, CASE WHEN k % 11 = 0 THEN 'unknown' WHEN k % 4 = 0 THEN 'meeting' ELSE 'gameplay' END AS label FROM ev),
        c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
        n AS (SELECT user_id, run, any_value(label) AS rl, count(*) AS size FROM r GROUP BY user_id, run),
        h AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY run ROWS UNBOUNDED PRECEDING) >= 3 OR rl = 'unknown' AS settled FROM n),
        j AS (SELECT user_id, coalesce(min(run) FILTER (settled), max(run)) AS head FROM h GROUP BY user_id),
        m AS (SELECT h.*, head, CASE WHEN run = head OR (run > head AND (size >= 3 OR rl = 'unknown')) THEN rl END AS own FROM h JOIN j USING (user_id)),
        o AS (SELECT *, CASE WHEN run < head THEN max(rl) FILTER (run = head) OVER (PARTITION BY user_id) ELSE last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY run ROWS UNBOUNDED PRECEDING) END AS smoothed FROM m)
        SELECT r.user_id, event_id, label, smoothed FROM r JOIN o USING (user_id, run)""",
    "anchor_fusion": _FROM_FIRST.format(within=1200),
    "boundary_scan": f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, s, event_type, row_number() OVER (PARTITION BY user_id ORDER BY s, event_type) AS n FROM ev),
        f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS opened, CAST(-1e18 AS DOUBLE) AS ready, CAST(0 AS BIGINT) AS done, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM r GROUP BY user_id
            UNION ALL SELECT f.user_id, r.n, CASE WHEN s < ready THEN opened WHEN opened IS NULL AND event_type IN ('signup', 'view') THEN s WHEN opened IS NOT NULL AND event_type IN ('error', 'purchase') AND s - opened >= 300 THEN NULL ELSE opened END,
                CASE WHEN s >= ready AND opened IS NOT NULL AND event_type IN ('error', 'purchase') AND s - opened >= 300 THEN s + 180 ELSE ready END,
                done + CASE WHEN s >= ready AND opened IS NOT NULL AND event_type IN ('error', 'purchase') AND s - opened >= 300 THEN 1 ELSE 0 END,
                CASE WHEN s >= ready AND opened IS NOT NULL AND event_type IN ('error', 'purchase') AND s - opened >= 300 THEN opened END, CASE WHEN s >= ready AND opened IS NOT NULL AND event_type IN ('error', 'purchase') AND s - opened >= 300 THEN s END
                FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
        SELECT user_id, done - 1 AS episode, a AS start_sec, b AS end_sec FROM f WHERE a IS NOT NULL""",
    "stream_boundary_scan": f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, s, event_type, row_number() OVER (PARTITION BY user_id ORDER BY s, event_type) AS n FROM ev),
        f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS opened, CAST(-1e18 AS DOUBLE) AS ready, CAST(0 AS BIGINT) AS done, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM r GROUP BY user_id
            UNION ALL SELECT f.user_id, r.n, CASE WHEN s < ready THEN opened WHEN opened IS NULL AND event_type IN ('signup', 'view') THEN s WHEN opened IS NOT NULL AND event_type IN ('error', 'purchase') AND s - opened >= 300 THEN NULL ELSE opened END,
                CASE WHEN s >= ready AND opened IS NOT NULL AND event_type IN ('error', 'purchase') AND s - opened >= 300 THEN s + 180 ELSE ready END,
                done + CASE WHEN s >= ready AND opened IS NOT NULL AND event_type IN ('error', 'purchase') AND s - opened >= 300 THEN 1 ELSE 0 END,
                CASE WHEN s >= ready AND opened IS NOT NULL AND event_type IN ('error', 'purchase') AND s - opened >= 300 THEN opened END, CASE WHEN s >= ready AND opened IS NOT NULL AND event_type IN ('error', 'purchase') AND s - opened >= 300 THEN s END
                FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
        SELECT user_id, done - 1 AS episode, a AS start_sec, b AS end_sec FROM f WHERE a IS NOT NULL""",
    "asof_snapshot": f"""WITH {EV}, snaps AS (
        SELECT user_id, s AS snap_s, event_id AS snap_id, round(value, 2) AS snap_value,
               row_number() OVER (PARTITION BY user_id, s ORDER BY event_id) AS rn FROM ev WHERE event_type = 'purchase'),
        asks AS (SELECT event_id, user_id, s FROM ev WHERE event_type = 'error')
        SELECT a.event_id, a.user_id, a.s, snap_id, snap_s, snap_value
        FROM asks a ASOF LEFT JOIN (SELECT * FROM snaps WHERE rn = 1) p ON a.user_id = p.user_id AND a.s + 1e-6 >= p.snap_s""",
    "nearest_interval": f"""WITH {EV}, v AS (SELECT * FROM ev WHERE event_type = 'view')
        SELECT p.event_id, p.user_id, min(greatest(v.s - p.s, p.s - v.e, 0.0)) AS distance
        FROM ev p LEFT JOIN v USING (user_id) WHERE p.event_type = 'click' GROUP BY p.event_id, p.user_id""",
    "containment_parent": f"""WITH {EV}, met AS (
        SELECT c.event_id, p.event_id AS parent_id, row_number() OVER (PARTITION BY c.event_id ORDER BY p.e + 600 - p.s, p.event_id) AS rn
        FROM ev c LEFT JOIN ev p ON p.event_type = 'view' AND p.s <= c.s AND p.e + 600 >= c.s + 5 WHERE c.event_type = 'click')
        SELECT event_id, parent_id FROM met WHERE rn = 1""",
    "place_of_events": f"""WITH {EV}, {GAMES}, p AS (SELECT game_id, event_id AS span_id, s AS ps, s + CASE WHEN k % 10 = 0 THEN 86400 WHEN k % 3 = 0 THEN 3600 ELSE 60 END AS pe FROM gv WHERE event_type <> 'click'),
        m AS (SELECT event_id, span_id, row_number() OVER (PARTITION BY event_id ORDER BY pe - ps, span_id) AS rn FROM gv JOIN p ON p.game_id = gv.game_id AND ps <= s + 60 AND pe > s + 60)
        SELECT event_id, span_id FROM m WHERE rn = 1""",
    "band_join_reaction": f"""WITH {EV} SELECT c.event_id AS claim_id, r.event_id AS reply_id, r.s - c.e AS gap
        FROM ev c JOIN ev r ON c.event_type = 'view' AND r.event_type = 'purchase' AND r.s - c.e BETWEEN 5 AND 300 AND c.user_id <> r.user_id""",
    "chain_cluster_consensus": f"""WITH {EV}, g AS (
        SELECT *, CASE WHEN s - lag(s) OVER w > 900 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY s)),
        c AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY s ROWS UNBOUNDED PRECEDING) AS cluster FROM g),
        a AS (SELECT event_type, cluster, min(s) AS first, median(s) AS abs_sec, count(DISTINCT user_id) AS n_users, count(*) AS n_events FROM c GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (ORDER BY first, event_type) - 1 AS boundary_index FROM a)
        SELECT event_type, abs_sec, n_users, boundary_index, n_events FROM n WHERE n_users >= 2""",
    "phase_islands": f"""WITH {EV}, r AS (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS grp FROM ev)
        SELECT user_id, event_type, min(s) AS start_sec, max(e) AS end_sec, count(*) AS n_rows FROM r GROUP BY user_id, event_type, grp""",
    "phase_split": f"""WITH {EV}, b AS (SELECT user_id, s, min(event_type) AS event_type FROM ev WHERE event_type IN ('view', 'purchase') GROUP BY user_id, s)
        SELECT user_id, row_number() OVER w - 1 AS phase_index, CASE WHEN event_type = 'view' THEN 'gameplay' ELSE 'meeting' END AS phase_type,
               s AS abs_start_sec, coalesce(lead(s) OVER w, 2592000.0) AS abs_end_sec FROM b WINDOW w AS (PARTITION BY user_id ORDER BY s)""",
    "episode_build": f"""WITH {EV}, b AS (SELECT user_id, s, min(event_type) AS event_type FROM ev GROUP BY user_id, s),
        st AS (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS episode_index FROM b WHERE event_type = 'signup'),
        en AS (SELECT st.user_id, st.s, min(b.s) AS stop FROM st JOIN b ON b.user_id = st.user_id AND b.event_type = 'error' AND b.s > st.s AND (st.nxt IS NULL OR b.s < st.nxt) GROUP BY ALL)
        SELECT st.user_id, episode_index, st.s AS abs_start_sec, coalesce(stop, nxt, 2592000.0) AS abs_end_sec FROM st LEFT JOIN en USING (user_id, s)""",
    "phase_chunks": f"""WITH {EV}, parts AS (
        SELECT event_id, unnest([s, s + 35, s + 61]) AS a, unnest([s + 20, s + 60, e]) AS b, e FROM ev),
        ok AS (SELECT event_id, a, least(b, e) AS b FROM parts WHERE least(b, e) > a),
        n AS (SELECT *, unnest(range(0, CAST(ceil((b - a) / 15) AS BIGINT))) AS i FROM ok)
        SELECT event_id, a + i * 15 AS start_sec, least(b, a + (i + 1) * 15) AS end_sec FROM n""",
    "sliding_windows": f"""WITH {EV}, t AS (SELECT event_id, s, s + 40 + event_id % 300 AS stop FROM ev),
        n AS (SELECT *, unnest(range(0, greatest(CAST(ceil((stop - s - 10) / 80) AS BIGINT), 1))) AS window_no FROM t)
        SELECT event_id, window_no, s + window_no * 80 AS start_sec, least(stop, s + window_no * 80 + 90) AS end_sec FROM n""",
    "last_n_history": f"""WITH {EV}, r AS (
        SELECT c.event_id, i.event_id AS item, i.s, row_number() OVER (PARTITION BY c.event_id ORDER BY i.s DESC, i.event_id DESC) AS rn
        FROM ev c LEFT JOIN ev i ON i.user_id = c.user_id AND i.event_type IN ('view', 'click') AND i.s <= c.s WHERE c.event_type = 'error')
        SELECT event_id, coalesce(string_agg(printf('%09d', item), ',' ORDER BY s, item) FILTER (item IS NOT NULL), '') AS history FROM r WHERE rn <= 5 GROUP BY event_id""",
    "phase_enrich": f"""WITH {EV} SELECT event_id, row_number() OVER w - 1 AS phase_index, row_number() OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS round_in_kind,
        lag(event_id) OVER w AS previous_phase_id, lead(event_id) OVER w AS next_phase_id FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)""",
    "previous_state": f"""WITH {EV} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN round(value, 2) END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM ev""",
    "weighted_vote_tick": f"""WITH {EV}, {GAMES}, w AS (SELECT game_id, event_type, s, e + 1800 AS e, greatest(0.1, (k % 8) / 8) AS w, row_number() OVER (PARTITION BY game_id ORDER BY s, event_id) AS seq FROM gv),
        t AS (SELECT game_id, unnest(range(0, CAST(ceil(max(e) / 3600) AS BIGINT))) AS tick FROM w GROUP BY game_id),
        v AS (SELECT t.game_id, tick, event_type, sum(w) AS score, min(seq) AS first FROM t JOIN w ON t.game_id = w.game_id AND s <= (tick + 0.5) * 3600 AND e > (tick + 0.5) * 3600 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY game_id, tick ORDER BY score DESC, first) AS rn, sum(score) OVER (PARTITION BY game_id, tick) AS total FROM v)
        SELECT game_id, tick, event_type, round(score / total, 3) AS share FROM r WHERE rn = 1""",
    "next_within_horizon": f"""WITH {EV}, m AS (
        SELECT c.event_id, n.event_id AS next_id, row_number() OVER (PARTITION BY c.event_id ORDER BY n.s, n.event_id) AS rn
        FROM ev c JOIN ev n ON c.event_type = 'purchase' AND n.s > c.e AND n.s <= c.e + 600 AND n.user_id <> c.user_id)
        SELECT event_id, next_id FROM m WHERE rn = 1""",
    "uniform_grid": f"""WITH {EV}, g AS (
        SELECT user_id AS grp, s, e FROM ev UNION ALL
        SELECT -1 - event_id % 5, floor(event_id / 5) * 30.0, floor(event_id / 5) * 30.0 + 10 FROM ev WHERE event_id < 50),
        d AS (SELECT grp, round(e - s, 3) AS d, round(lead(s) OVER (PARTITION BY grp ORDER BY s) - s, 3) AS g FROM g)
        SELECT grp, count(*) AS n_rows, count(*) >= 3 AND count(DISTINCT d) = 1 AND count(DISTINCT g) = 1 AS is_grid FROM d GROUP BY grp""",
    "first_state": f"""WITH {EV}, a AS (SELECT user_id, min(s) FILTER (event_type = 'purchase') AS after_at FROM ev GROUP BY user_id)
        SELECT user_id, max(s) FILTER (event_type = 'view' AND s < after_at) AS before_at, any_value(after_at) AS after_at FROM ev JOIN a USING (user_id) GROUP BY user_id""",
    "sample_times": f"""WITH {EV}, t AS (SELECT event_id, s, e, unnest(range(0, CAST(floor((e - s) * 0.125) AS BIGINT) + 1)) AS i FROM ev),
        u AS (SELECT event_id, s + i / 0.125 AS moment FROM t UNION SELECT event_id, e FROM t)
        SELECT event_id, count(*) AS n_samples, max(moment) AS last_at, sum(moment) AS sum_at FROM u GROUP BY event_id""",
    "timed_event_repair": f"""WITH {EV} SELECT event_id, event_id % 8 IN (0, 1, 2, 3, 6) AS ok,
        CASE event_id % 8 WHEN 0 THEN 'already_local' WHEN 1 THEN CASE WHEN s + 9 <= e - s + 0.05 THEN 'already_local' ELSE 'converted_abs_to_local' END
            WHEN 2 THEN 'swapped_time_order' WHEN 3 THEN 'expanded_point_time' WHEN 4 THEN 'unrecognized_time' WHEN 5 THEN 'outside_phase_time' WHEN 6 THEN 'already_local' ELSE 'missing_time' END AS reason,
        CASE event_id % 8 WHEN 0 THEN s + 5 WHEN 1 THEN s + 2 + CASE WHEN s + 9 <= e - s + 0.05 THEN s ELSE 0 END WHEN 2 THEN s + 10 WHEN 3 THEN s + 7 WHEN 6 THEN s END AS abs_start,
        CASE event_id % 8 WHEN 0 THEN s + 9 WHEN 1 THEN s + 9 + CASE WHEN s + 9 <= e - s + 0.05 THEN s ELSE 0 END WHEN 2 THEN s + 20 WHEN 3 THEN s + 8 WHEN 6 THEN e END AS abs_end FROM ev""",
    "affine_fit_least_squares": f"""WITH {EV}, r AS (SELECT *, s * 1.001 + 5 + k % 3 AS raw FROM ev),
        f AS (SELECT user_id, regr_slope(raw, s) AS scale, regr_intercept(raw, s) AS off, count(*) AS n FROM r GROUP BY user_id),
        d AS (SELECT user_id, n, scale, abs(raw - (scale * s + off)) AS res FROM r JOIN f USING (user_id))
        SELECT user_id, max(n) AS n, round(max(scale), 6) AS scale, round(median(res), 4) AS median_residual,
               round(list_sort(list(res))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1], 4) AS p95_residual FROM d GROUP BY user_id""",
    "stratified_quota_topk": f"""WITH {EV}, st(event_type, r, q) AS (VALUES ('purchase', 0, 10), ('error', 1, 35), ('signup', 2, 15), ('view', 3, 15), ('click', 4, 10)),
        n AS (SELECT ev.*, r, q, row_number() OVER (PARTITION BY event_type ORDER BY s, event_id) AS seq FROM ev JOIN st USING (event_type)),
        o AS (SELECT *, row_number() OVER (PARTITION BY event_type, k ORDER BY CASE WHEN seq > q THEN 1 ELSE 0 END, r, seq) AS d FROM n)
        SELECT event_id, event_type, k FROM o WHERE d = 1 ORDER BY CASE WHEN seq > q THEN 1 ELSE 0 END, r, seq LIMIT 100""",
    "keep_first_dedupe": f"WITH {EV} SELECT event_id, user_id, k FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY s, event_id) = 1",
    "latest_attempt_dedupe": f"""WITH {EV}, a AS (SELECT user_id || '|' || (k % 5) AS task_key, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status FROM ev)
        SELECT task_key, event_id, status FROM a QUALIFY row_number() OVER (PARTITION BY task_key ORDER BY status = 'ok' DESC, event_id DESC) = 1""",
    "index_gaps": f"""WITH {EV}, u AS (SELECT DISTINCT user_id, k FROM ev),
        w AS (SELECT user_id, unnest(range(0, max(k) + 1)) AS k FROM u GROUP BY user_id) SELECT user_id, k FROM w EXCEPT SELECT user_id, k FROM u""",
    "sliced_rows": f"""WITH {EV}, n AS (SELECT event_id, s, row_number() OVER (ORDER BY s, event_id) - 1 AS p FROM ev WHERE event_type = 'click')
        SELECT event_id, s FROM n WHERE p >= 3 AND (p - 3) % 7 = 0 ORDER BY p LIMIT 50""",
    "safe_event_ids": f"""WITH RECURSIVE {EV}, {GAMES}, r AS (SELECT game_id, event_id, 'ge_' || (k % 3) || CASE WHEN k % 7 = 0 THEN '_' || event_type WHEN k % 11 = 0 THEN '_click_2' ELSE '' END AS id, event_type AS suffix, row_number() OVER (PARTITION BY game_id ORDER BY s, event_id) AS n FROM gv),
        f AS (SELECT game_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS safe_id, CAST([] AS VARCHAR[]) AS used FROM r GROUP BY game_id
            UNION ALL SELECT game_id, n, event_id, name, list_append(used, name) FROM (SELECT r.*, used, list_filter(list_concat([id, id || '_' || suffix], list_transform(range(2, r.n + 2), lambda i: id || '_' || suffix || '_' || i)), lambda x: NOT list_contains(used, x))[1] AS name
                FROM f JOIN r ON r.game_id = f.game_id AND r.n = f.n + 1))
        SELECT event_id, safe_id FROM f WHERE n > 0""",
    "row_shards": f"""WITH {EV}, n AS (SELECT event_id, (row_number() OVER (ORDER BY s, event_id) - 1) // 64 AS shard FROM ev)
        SELECT shard, count(*) AS n_rows, min(event_id) AS first_id FROM n GROUP BY shard""",
    "eval_metrics_rollup": f"""WITH {EV}, r AS (
        SELECT user_id % 4 AS track, CASE WHEN k % 9 = 0 THEN 'unknown' ELSE CAST(k % 3 AS VARCHAR) END AS probe, value AS latency_sec,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status, k % 2 = 0 AS parse_ok, CASE WHEN k % 5 <> 0 THEN k % 3 = 0 END AS schema_ok FROM ev)
        SELECT track, CASE WHEN grouping(probe) = 1 THEN '(all)' ELSE probe END AS probe, count(*) AS n_rows, count(*) FILTER (status <> 'skipped') AS attempted, count(*) FILTER (status = 'ok') AS n_ok,
               count(*) FILTER (status = 'error') AS n_errors, count(*) FILTER (status = 'skipped') AS n_skipped,
               round(coalesce(count(*) FILTER (status <> 'skipped' AND parse_ok) / nullif(count(*) FILTER (status <> 'skipped'), 0), 0.0), 6) AS parse_rate,
               round(coalesce(count(*) FILTER (status <> 'skipped' AND schema_ok) / nullif(count(*) FILTER (status <> 'skipped'), 0), 0.0), 6) AS schema_rate,
               coalesce((2 * sum(CAST(round(latency_sec * 1000000) AS BIGINT)) FILTER (status = 'ok') + count(*) FILTER (status = 'ok')) // nullif(2 * count(*) FILTER (status = 'ok'), 0) / 1000000, 0.0) AS mean_latency_sec
        FROM r GROUP BY GROUPING SETS ((track), (track, probe))""",
}
