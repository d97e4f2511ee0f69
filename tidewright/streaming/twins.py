"""Structured Streaming twins of batch operators: windowed counts with a watermark, idempotent sinks, stateful scans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.sources.commits import CommitLog


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunk_counts(events: DataFrame, at: str, size: str, late: str, key: Sequence[str]) -> DataFrame:
    """Rows of each tumbling window and key; rows later than the watermark are dropped."""
    stream = events.withWatermark(at, late) if events.isStreaming else events
    return stream.groupBy(F.window(at, size).alias("_w"), *key).agg(F.count("*").alias("n_events")).select(F.col("_w.start").alias("window_start"), *key, "n_events")


def session_counts(events: DataFrame, at: str, gap: str, late: str, key: Sequence[str]) -> DataFrame:
    """Rows of each session: a gap of `gap` without rows ends it."""
    stream = events.withWatermark(at, late) if events.isStreaming else events
    return stream.groupBy(F.session_window(at, gap).alias("_w"), *key).agg(F.count("*").alias("n_events")).select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *key, "n_events")


def run_to_memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a streaming plan over what is there now and returns the sink's table; for tests and small results."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a streaming plan in append mode over what is there now, into Parquet files at `path`, each row once; the table so far.

    State with timers needs the RocksDB store, which is set for the time of the run.
    """
    conf, provider = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(provider)
    conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    try:
        query.awaitTermination()
    finally:
        query.stop()
        conf.set(provider, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_complete(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregation in complete mode over what is there now; each batch's result replaces the one before at `path`, as a commit."""
    log = CommitLog(df.sparkSession, path)
    query = df.writeStream.outputMode("complete").foreachBatch(lambda batch, _: log.overwrite(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return log.read()


def append_sink(path: str, key: str):
    """For foreachBatch: appends rows whose key the table lacks, so that a batch that runs twice adds nothing."""
    from tidewright.plans.stages import append_once

    def sink(batch: DataFrame, _: int) -> None:
        append_once(batch.dropDuplicates([key]), path, key)

    return sink


def carry_forward(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each row with the running count and the last value of its key before it, state kept between batches."""
    kinds = dict(events.dtypes)

    def step(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (0, None)
        for rows in batches:
            out = []
            for t, v in sorted(zip(rows[at], rows["_value"])):
                out.append((names[0], t, seen, last))
                seen, last = seen + 1, float(v)
            yield pd.DataFrame(out, columns=[key, at, "seen_before", "last_before"])
        state.update((seen, last))

    return events.select(key, at, F.col(value).alias("_value")).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {at} {kinds[at]}, seen_before long, last_before double", "seen long, last double", "append", GroupStateTimeout.NoTimeout)


def boundary_scan(events: DataFrame, key: str, at: str, kind: str, starts: Sequence[str], ends: Sequence[str], skip_sec: float = 180.0, least_sec: float = 300.0) -> DataFrame:
    """The two-state scan over a stream in time order: episodes as they close; what is open is kept in state."""
    kinds = dict(events.dtypes)

    def step(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, ready, count = state.get if state.exists else (None, float("-inf"), 0)
        out = []
        rows = pd.concat(list(batches), ignore_index=True).sort_values([at, kind], kind="stable")
        for t, what in zip(rows[at], rows[kind]):
            if t < ready:
                continue
            if opened is None and what in starts:
                opened = float(t)
            elif opened is not None and what in ends and t - opened >= least_sec:
                out.append((names[0], count, opened, float(t)))
                opened, ready, count = None, t + skip_sec, count + 1
        state.update((opened, float(ready), count))
        yield pd.DataFrame(out, columns=[key, "episode", "start_sec", "end_sec"])

    return events.select(key, at, kind).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, episode long, start_sec double, end_sec double", "opened double, ready double, count long", "append", GroupStateTimeout.NoTimeout)
