"""Queries of evaluation reports and of segments' views over the `events` table, each with a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import selection
from tidewright.plans import scoring
from tidewright.plans.event_queries import EV, GAMES, games

_TRACKS = ("core", "raw", "open")


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of five tasks a player and track, of which two tracks have held-back gold (the signups of each trial)."""
    ev = games(spark, sf_dir)
    track = F.element_at(F.array(*[F.lit(t) for t in _TRACKS]), (F.col("k") % 3 + 1).cast("int"))
    trial = F.concat(F.lit("t"), F.col("k") % 20)
    attempts = ev.select(
        F.when(F.col("k") % 13 == 0, "").when(F.col("k") % 17 > 0, F.concat_ws("|", "user_id", F.col("k") % 15)).alias("task_key"), F.col("event_id").alias("seq"), track.alias("track"), F.concat(F.lit("m"), F.col("user_id") % 2).alias("model"),
        F.when(F.col("user_id") % 3 == 0, "video").otherwise("text").alias("modality"), F.when(F.col("k") % 19 > 0, trial).alias("trial_id"), F.when(F.col("k") % 9 == 0, "").when(F.col("k") % 7 > 0, F.concat(F.lit("probe "), F.col("k") % 4)).alias("probe_type"),
        F.when(F.col("k") % 2 == 0, "own").alias("gold_source"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").when(F.col("k") % 11 > 0, "ok").alias("status"),
        (F.col("k") % 2 == 0).alias("parse_ok"), F.when(F.col("k") % 5 != 0, F.col("k") % 3 == 0).alias("schema_ok"), F.when(F.col("k") % 6 > 0, F.col("value")).alias("latency_sec"),
    )
    gold = ev.where("event_type = 'signup' and k % 3 < 2").select(
        track.alias("track"), F.when(F.col("event_id") % 29 > 0, trial).alias("trial_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("source "), F.col("event_id") % 3)).alias("gold_source"), F.when(F.col("event_id") % 4 == 0, "nested").alias("nested_source"),
    )
    return scoring.evaluation_report(attempts, gold, ["m1"])


def segment_povs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of one player (the filter is the feature) in all hours of their game."""
    view = F.struct(F.concat(F.lit("p"), F.col("user_id")).alias("player_id"), F.concat(F.lit("v/"), F.col("user_id"), F.lit(".mp4")).alias("video_file"))
    segments = games(spark, sf_dir).groupBy("game_id", F.floor(F.col("s") / 3600).alias("hour")).agg(F.array_sort(F.collect_set(view)).alias("povs"))
    return selection.povs_of(segments, "p7", ["game_id", "hour"])


def player_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty clips of a player in a game (filters and the limit are the feature)."""
    clips = games(spark, sf_dir).select("event_id", "game_id", F.col("user_id").alias("player_id"), "s", "e")
    return selection.clips_of(clips, ["s", "event_id"], 1, 7, 50)


QUERIES = {f.__name__: f for f in (evaluation_report, segment_povs, player_clips)}

_G = f"WITH {EV}, {GAMES}"
ORACLE_SQL = {
    "evaluation_report": _G + """, a AS (SELECT user_id || '|' || (k % 15) AS task_key, ['core', 'raw', 'open'][k % 3 + 1] AS track, 'm' || (user_id % 2) AS model, CASE WHEN user_id % 3 = 0 THEN 'video' ELSE 'text' END AS modality, CASE WHEN k % 19 > 0 THEN 't' || (k % 20) END AS trial_id,
            CASE WHEN k % 9 = 0 OR k % 7 = 0 THEN 'unknown' ELSE 'probe ' || (k % 4) END AS probe_type, CASE WHEN k % 2 = 0 THEN 'own' END AS own, coalesce(CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'skipped' WHEN k % 11 > 0 THEN 'ok' END, 'none') AS status,
            k % 2 = 0 AS parse_ok, CASE WHEN k % 5 <> 0 THEN k % 3 = 0 END AS schema_ok, CASE WHEN k % 6 > 0 THEN value ELSE 0.0 END AS took FROM gv WHERE k % 13 > 0 AND k % 17 > 0
            QUALIFY row_number() OVER (PARTITION BY user_id, k % 15 ORDER BY event_type NOT IN ('error', 'signup') AND k % 11 > 0 DESC, event_id DESC) = 1),
        g AS (SELECT ['core', 'raw'][k % 3 + 1] AS track, 't' || (k % 20) AS trial_id, CASE WHEN event_id % 4 = 0 THEN 'nested' WHEN event_id % 3 > 0 THEN 'source ' || (event_id % 3) END AS source FROM gv WHERE event_type = 'signup' AND k % 3 < 2 AND event_id % 29 > 0
            QUALIFY row_number() OVER (PARTITION BY k % 3, k % 20 ORDER BY event_id DESC) = 1),
        r AS (SELECT a.*, coalesce(CASE WHEN track = 'open' THEN own ELSE source END, 'unknown') AS gold_source FROM a LEFT JOIN g USING (track, trial_id)),
        l AS (SELECT *, 'all' AS level, '' AS name FROM r UNION ALL SELECT *, 'probe_type', probe_type FROM r UNION ALL SELECT *, 'gold_source', gold_source FROM r)
        SELECT track, model, modality, level, name, model = 'm1' AS same_model, count(*) AS n_rows, count(*) FILTER (status <> 'skipped') AS attempted, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_errors, count(*) FILTER (status = 'skipped') AS n_skipped,
            round(coalesce(count(*) FILTER (status <> 'skipped' AND parse_ok) / nullif(count(*) FILTER (status <> 'skipped'), 0), 0.0), 6) AS parse_rate, round(coalesce(count(*) FILTER (status <> 'skipped' AND schema_ok) / nullif(count(*) FILTER (status <> 'skipped'), 0), 0.0), 6) AS schema_rate,
            coalesce((2 * sum(CAST(round(took * 1000000) AS BIGINT)) FILTER (status = 'ok') + count(*) FILTER (status = 'ok')) // nullif(2 * count(*) FILTER (status = 'ok'), 0) / 1000000, 0.0) AS mean_latency_sec
        FROM l GROUP BY ALL""",
    "segment_povs": _G + " SELECT DISTINCT game_id, CAST(floor(s / 3600) AS BIGINT) AS hour, 'p7' AS player_id, 'v/7.mp4' AS video_file FROM gv WHERE user_id = 7",
    "player_clips": _G + " SELECT event_id, game_id, user_id AS player_id, s, e FROM gv WHERE user_id = 7 AND game_id = 1 ORDER BY s, event_id LIMIT 50",
}
