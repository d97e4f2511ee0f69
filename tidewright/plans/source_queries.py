"""Queries that write files to the shared folder and read them back through the sources, each with a DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import scratch
from tidewright.plans import evaluation
from tidewright.plans.event_queries import EV, GAMES, games, ledger_tables
from tidewright.session import table
from tidewright.sources import files, ledgers


def _k() -> Column:
    return F.col("k")


def _folder(spark: SparkSession) -> str:
    return f"{scratch.shared_dir(spark)}/tidewright-{uuid.uuid4().hex}"


def ledger_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a ledger written as JSON lines and loaded again; those without a file are empty."""
    events, claims, _ = ledger_tables(games(spark, sf_dir))
    root = _folder(spark)
    tables = {"world_events": events, "claims": claims}
    ledgers.write_ledger(tables, root)
    schemas = {n: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables[n].schema) if n in tables else "x string" for n in ledgers.LEDGER}
    loaded = ledgers.load_ledger(spark, root, schemas)
    core = ledgers.load_ledger(spark, root, schemas, ledgers.CORE)
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows", F.lit(n in core).alias("in_core")) for n, df in loaded.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(loaded["claims"].groupBy("claim_type" if "claim_type" in claims.columns else "content").agg(F.count("*").alias("n_rows")).select(F.col("content").alias("table_name"), "n_rows", F.lit(False).alias("in_core")))


def json_line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with broken ones among them: good rows, quarantined lines, and lines in all."""
    path = _folder(spark)
    line = F.when(_k() % 7 == 0, "{broken").when(_k() % 11 == 0, "").otherwise(F.to_json(F.struct("event_id", "k")))
    games(spark, sf_dir).select(line.alias("value")).write.text(path)
    good, bad = files.read_jsonl_with_errors(spark, path, "event_id long, k long")
    counts = files.line_counts(spark, path).agg(F.sum("n_lines").alias("n_lines"))
    return good.agg(F.count("event_id").alias("n_good"), F.sum("k").alias("sum_k")).crossJoin(bad.agg(F.count("*").alias("n_bad"))).crossJoin(counts)  # a row each


def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks exported without their private column, CSV, sorted JSON lines and the manifest of all files, read back."""
    root = _folder(spark)
    ev = games(spark, sf_dir).select("event_id", "k", "event_type", F.col("value").alias("secret"))
    files.export_tracks(ev, root, "event_type", ["secret"], {"even": _k() % 2 == 0})
    files.write_csv(ev.select("event_id", "k"), f"{root}/table.csv")
    files.write_sorted_jsonl(ev.select("k", "event_id"), f"{root}/sorted")
    files.write_jsonl(ev.select("event_id"), f"{root}/log", "append")
    public = spark.read.json(f"{root}/public")
    hashed = files.manifest(spark, root, "*.json")
    same = files.manifest_issues(hashed, files.manifest(spark, root, "*.json"))
    first = spark.read.text(f"{root}/sorted").agg(F.min(F.length(F.substring_index("value", ":", 1))).alias("n")).select("n")
    parts = {
        "public": public.agg(F.count("*").cast("bigint")), "public_columns": spark.range(1).select(F.lit(len(public.columns)).cast("bigint")), "even": spark.read.json(f"{root}/tracks/even").agg(F.count("*")), "private": spark.read.json(f"{root}/private").agg(F.count("secret")),
        "csv": spark.read.option("header", True).schema("event_id long, k long").csv(f"{root}/table.csv").agg(F.sum("k")), "sorted": first.select(F.col("n").cast("bigint")), "log": spark.read.json(f"{root}/log").agg(F.count("*")), "manifest_issues": same.agg(F.count("*")),
    }
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("part"), F.col(df.columns[0]).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def release_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release built from another: provenance rewritten, other files copied, checked against its manifest and for markers."""
    source, target = _folder(spark), _folder(spark)
    line = F.to_json(F.struct("event_id", F.when(_k() % 2 == 0, "human_verified").otherwise("other").alias("gold_source"), F.lit("is human_verified").alias("note")))
    games(spark, sf_dir).select(line.alias("value")).write.text(f"{source}/rows.jsonl")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).coalesce(1).write.text(f"{source}/notes")
    ledgers.write_json(spark, {"b": 1, "a": [1, 2]}, f"{source}/keep/meta.json")
    # Spark names its files part-*.txt, so what are lines here are told by their folder.
    lines = spark.read.text(f"{source}/rows.jsonl").select(ledgers.model_verified(F.col("value")).alias("value"))
    lines.write.text(f"{target}/public")
    copied = ledgers.copy_tree(spark, source, f"{target}/assets", ["rows.jsonl", "_SUCCESS"])
    n_copied = copied.where("path not like '%crc'").agg(F.count("*").alias("n")).first()["n"]
    recorded = files.manifest(spark, target)
    problems = ledgers.release_issues(spark, target, recorded, ["human_verified"]).count()
    back = spark.read.text(f"{target}/public").select(F.get_json_object("value", "$.gold_source").alias("g"), F.get_json_object("value", "$.note").alias("note"))
    meta = spark.read.text(f"{target}/assets/keep/meta.json").first()["value"]
    return back.groupBy("g", "note").agg(F.count("*").alias("n_lines")).withColumns({"n_copied": F.lit(n_copied).cast("bigint"), "n_issues": F.lit(problems).cast("bigint"), "meta": F.lit(meta)})


def result_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files of users, of which neighbours may have equal content."""
    ev = games(spark, sf_dir)
    rows = ev.where("k < 8").select(F.concat(F.lit("f"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("path"), F.lit("m").alias("model"), F.lit("s").alias("setting"), F.col("k").alias("position"), F.col("k").cast("string").alias("row_id"), (_k() % 2 == 0).alias("correct")).distinct()
    return ledgers.result_sets(rows).select("path", "n", "n_correct")


def recovered_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(_k() % 4 == 0, '[{"a": 1}, {"b":').when(_k() % 4 == 1, 'text {"a": {"b": 2}} tail').when(_k() % 4 == 2, "nothing").otherwise('```json\n[{"a": 1}, {"b": 2}]\n```')
    rows = games(spark, sf_dir).select(F.lit("stage").alias("stage"), F.col("event_id").alias("key"), raw.alias("raw"), (_k() % 3 > 0).alias("lists"))
    return ledgers.recovered(rows).select("key", "status", F.size("items").cast("bigint").alias("n_items"))


def _answer(prompt: str) -> str:
    """A client for tests and queries: offsets and boundaries that turn on the number at the prompt's end."""
    n = int(prompt.rsplit(" ", 1)[-1])
    if prompt.startswith("sync"):
        return f'[{{"raw_start_sec": {n}.5, "confidence": "高"}}]' if n % 3 else "no idea"
    return f'[{{"boundary_type": "game_start", "evidence": "e{n}", "aligned_start_sec": {n}}}, {{"boundary_type": "x"}}]' if n % 4 else "{}"


def sync_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = games(spark, sf_dir).select("game_id", F.col("user_id").alias("player_id")).distinct()
    known = users.where("player_id % 2 = 0").select("game_id", "player_id", F.lit(1.0).alias("raw_start_sec"), F.when(F.col("player_id") % 4 == 0, 0.0).otherwise(0.7).alias("confidence"))
    return evaluation.sync_loop(users.withColumn("prompt", F.concat(F.lit("sync "), F.col("player_id").cast("string"))), evaluation.client_of("mock-2", {"mock": _answer}), known)


def boundary_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    clip = F.struct(F.format_string("c%d", "event_id").alias("clip_id"), "game_id", F.col("user_id").cast("string").alias("player_id"), F.lit(0.0).alias("start_sec"), F.lit(50.0).alias("end_sec"))
    clips = ev.select(clip.alias("clip"), F.concat(F.lit("scan "), _k().cast("string")).alias("prompt"))
    found, errors = evaluation.boundary_loop(clips, _answer, F.col("boundary_type") == "game_start")
    good = found.select("clip_id", "aligned_start_sec", "aligned_end_sec", "needs_review", F.lit("ok").alias("status"))
    return good.unionByName(errors.select("clip_id", F.lit(None).cast("double").alias("aligned_start_sec"), F.lit(None).cast("double").alias("aligned_end_sec"), F.lit(None).cast("boolean").alias("needs_review"), F.lit("error").alias("status")))


QUERIES = {f.__name__: f for f in (ledger_round_trip, json_line_sources, export_round_trip, release_round_trip, result_sets, recovered_errors, sync_loop, boundary_loop)}

_G = f"WITH {EV}, {GAMES}"
ORACLE_SQL = {
    "ledger_round_trip": _G + """ SELECT t AS table_name, CASE t WHEN 'world_events' THEN (SELECT count(*) FROM gv WHERE event_type <> 'error') WHEN 'claims' THEN (SELECT count(*) FROM gv WHERE event_type = 'error') ELSE 0 END AS n_rows, t NOT IN ('phase_events', 'canonical_event_map') AS in_core
        FROM (SELECT unnest(['world_events', 'claims', 'phase_events', 'visibility_edges', 'belief_memory_snapshots', 'claim_truth_links', 'canonical_event_map']) AS t) UNION ALL
        SELECT CASE k % 4 WHEN 0 THEN '我没有杀人' WHEN 1 THEN 'seen in room' || (k % 7) WHEN 2 THEN '投票' ELSE '...' END, count(*), false FROM gv WHERE event_type = 'error' GROUP BY 1""",
    "json_line_sources": _G + """ SELECT count(*) FILTER (k % 7 <> 0 AND k % 11 <> 0) AS n_good, CAST(sum(k) FILTER (k % 7 <> 0 AND k % 11 <> 0) AS BIGINT) AS sum_k, count(*) FILTER (k % 7 = 0) AS n_bad, count(*) FILTER (k % 7 = 0 OR k % 11 <> 0) AS n_lines FROM gv""",
    "export_round_trip": _G + """, c AS (SELECT count(*) AS n, count(*) FILTER (k % 2 = 0) AS ev, CAST(sum(k) AS BIGINT) AS sk FROM gv) SELECT unnest(['public', 'public_columns', 'even', 'private', 'csv', 'sorted', 'log', 'manifest_issues']) AS part, unnest([n, 3, ev, n, sk, 11, n, 0]) AS n FROM c""",
    "release_round_trip": _G + """ SELECT 'model_verified' AS g, 'is model_verified' AS note, count(*) AS n_lines, 2 AS n_copied, 0 AS n_issues, '{"a": [1, 2], "b": 1}' AS meta FROM gv""",
    "result_sets": _G + """, r AS (SELECT DISTINCT 'f' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS path, k FROM gv WHERE k < 8), e AS (SELECT path, count(*) AS n, count(*) FILTER (k % 2 = 0) AS c, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (k < 5) AS f FROM r GROUP BY path) SELECT min(path) AS path, n, c AS n_correct FROM e GROUP BY n, c, f""",
    "recovered_errors": _G + """ SELECT event_id AS key, CASE WHEN n > 0 THEN 'recovered' ELSE 'failed' END AS status, n AS n_items FROM (SELECT event_id, CAST(CASE WHEN k % 3 > 0 THEN [1, 0, 0, 2][k % 4 + 1] ELSE [1, 1, 0, 1][k % 4 + 1] END AS BIGINT) AS n FROM gv) z""",
    "sync_loop": _G + """ SELECT game_id, player_id, CASE WHEN player_id % 4 = 2 THEN 1.0 ELSE player_id + 0.5 END AS raw_start_sec, CASE WHEN player_id % 4 = 2 THEN 0.7 ELSE 0.9 END AS confidence FROM roster WHERE player_id % 4 = 2 OR player_id % 3 <> 0""",
    "boundary_loop": _G + """ SELECT 'c' || event_id AS clip_id, CASE WHEN k % 4 > 0 THEN CASE WHEN k >= 50 THEN 49.0 ELSE k END END AS aligned_start_sec, CASE WHEN k % 4 > 0 THEN 50.0 END AS aligned_end_sec, CASE WHEN k % 4 > 0 THEN k >= 50 END AS needs_review, CASE WHEN k % 4 > 0 THEN 'ok' ELSE 'error' END AS status FROM gv""",
}

#: Columns whose literals DuckDB would take for narrower types.
for _name, _types in {
    "release_round_trip": {"n_copied": "BIGINT", "n_issues": "BIGINT"},
    "sync_loop": {"raw_start_sec": "DOUBLE", "confidence": "DOUBLE"},
    "boundary_loop": {"aligned_start_sec": "DOUBLE", "aligned_end_sec": "DOUBLE"},
}.items():
    _casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _types.items())
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE_SQL[_name]}) AS q"
