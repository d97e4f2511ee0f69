"""Sequences in time: clusters, phases, tilings, sliding windows, histories at cutoffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import with_position


def chain_clusters(df: DataFrame, key: Sequence[str], at: str, gap: float, order: Sequence[str] = ()) -> DataFrame:
    """`cluster` numbers per key: a row more than `gap` after the one before it begins a new cluster."""
    w = Window.partitionBy(*key).orderBy(at, *order)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def consensus(df: DataFrame, kind: str, at: str, player: str, evidence: str, public: Column | None = None, tolerance: float = 3.0, least: int = 2) -> DataFrame:
    """Clusters of one kind seen by `least` players or shown in public: median time, players, evidence, and `index`.

    The index numbers all clusters by their first row before any is dropped, so kept ones may have gaps.
    """
    rows = chain_clusters(df.withColumn("_public", F.coalesce(public, F.lit(False)) if public is not None else F.lit(False)), [kind], at, tolerance)
    groups = rows.groupBy(kind, "cluster").agg(
        F.min(at).alias("_first"), F.percentile(at, F.lit(0.5)).alias("abs_sec"), F.array_sort(F.collect_set(player)).alias("source_povs"), F.array_sort(F.collect_set(F.col(evidence).cast("string"))).alias("evidence_ids"), F.bool_or("_public").alias("public_ui")
    )
    numbered = with_position(groups, ["_first", kind], "index")
    return numbered.where((F.size("source_povs") >= least) | F.col("public_ui")).drop("_first", "cluster")


def islands(df: DataFrame, key: Sequence[str], order: str, label: str, end: str) -> DataFrame:
    """Runs of equal labels: start, end, rows of each."""
    w = Window.partitionBy(*key).orderBy(order)
    change = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(0))
    runs = df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "_run", label).agg(F.min(order).alias("start_sec"), F.max(end).alias("end_sec"), F.count("*").alias("n_rows")).withColumnRenamed("_run", "run")


def phases(boundaries: DataFrame, key: Sequence[str], at: str, state: Column, end: str) -> DataFrame:
    """A boundary stream as intervals [t, next t) with a state; the last ends at `end`; index counts before empty ones go."""
    w = Window.partitionBy(*key).orderBy(at)
    out = boundaries.withColumns({"phase_type": state, "abs_start_sec": F.col(at), "abs_end_sec": F.coalesce(F.lead(at).over(w), F.col(end)), "phase_index": F.row_number().over(w) - 1})
    return out.where("abs_end_sec > abs_start_sec").select(*key, "phase_index", "phase_type", "abs_start_sec", "abs_end_sec")


def episodes(boundaries: DataFrame, key: Sequence[str], kind: str, at: str, starts: Sequence[str], ends: Sequence[str], session_end: Column) -> DataFrame:
    """From each start to the first end before the next start, else to the next start, else to the session's end."""
    marks = boundaries.withColumns({"_start": F.when(F.col(kind).isin(*starts), F.col(at)), "_end": F.when(F.col(kind).isin(*ends), F.col(at))})
    later = Window.partitionBy(*key).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    seen = marks.withColumns({"_next": F.min("_start").over(later), "_stop": F.min("_end").over(later), "_session": session_end}).where("_start is not null")
    stop = F.when(F.col("_next").isNull() | (F.col("_stop") < F.col("_next")), F.col("_stop"))
    out = seen.select(*key, F.col("_start").alias("abs_start_sec"), F.coalesce(stop, "_next", "_session").alias("abs_end_sec"))
    out = out.withColumn("episode_index", F.row_number().over(Window.partitionBy(*key).orderBy("abs_start_sec")) - 1)
    return out.where("abs_end_sec > abs_start_sec")


def tiles(df: DataFrame, start: str, end: str, size: float) -> DataFrame:
    """Consecutive windows of `size` over [start, end), the last one short: `tile`, start_sec, end_sec."""
    n = F.greatest(F.ceil((F.col(end) - F.col(start)) / size).cast("int"), F.lit(0))
    each = df.withColumn("tile", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    return each.withColumns({"start_sec": F.col(start) + F.col("tile") * size, "end_sec": F.least(F.col(end), F.col(start) + (F.col("tile") + 1) * size)})


def sliding(df: DataFrame, start: str, end: str, size: float, overlap: float, least: float = 0.0) -> DataFrame:
    """Windows of `size` every size - overlap; the last is cut at `end`, after which none begins; shorter than `least` go."""
    step = size - overlap
    n = F.greatest(F.ceil((F.col(end) - F.col(start) - overlap) / step).cast("int"), F.when(F.col(end) > F.col(start), 1).otherwise(0))
    each = df.withColumn("window", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    out = each.withColumns({"start_sec": F.col(start) + F.col("window") * step, "end_sec": F.least(F.col(end), F.col(start) + F.col("window") * step + size)})
    return out.where(F.col("end_sec") - F.col("start_sec") >= least)


def subtract(start: Column, end: Column, excluded: Column) -> Column:
    """[start, end) without the sorted intervals of an array of struct(start, end): an array of struct(start, end)."""
    pair = lambda s, e: F.struct(s.cast("double").alias("start"), e.cast("double").alias("end"))
    kind = "array<struct<start:double,end:double>>"

    def less(kept: Column, x: Column) -> Column:
        def split(k: Column) -> Column:
            apart = (x["end"] <= k["start"]) | (x["start"] >= k["end"])
            parts = F.filter(F.array(pair(k["start"], F.least(x["start"], k["end"])), pair(F.greatest(x["end"], k["start"]), k["end"])), lambda p: p["end"] > p["start"])
            return F.when(apart, F.array(pair(k["start"], k["end"]))).otherwise(parts)

        return F.flatten(F.transform(kept, split)).cast(kind)

    whole = F.filter(F.array(pair(start, end)), lambda p: p["end"] > p["start"]).cast(kind)
    return F.aggregate(F.array_sort(excluded), whole, less)


def phase_chunks(spans: DataFrame, start: str, end: str, excluded: Column, size: float, valid_from: float = 0.0, valid_to: float | None = None) -> DataFrame:
    """Phases clipped to a valid range, without excluded intervals, in chunks of at most `size` that never cross either."""
    s, e = F.greatest(F.col(start), F.lit(valid_from)), F.least(F.col(end), F.lit(valid_to)) if valid_to is not None else F.col(end)
    parts = spans.withColumn("_part", F.explode(subtract(s, e, excluded)))
    parts = parts.withColumns({"_s": F.col("_part.start"), "_e": F.col("_part.end")})
    return tiles(parts, "_s", "_e", size).drop("_part", "_s", "_e", "tile")


def sample_times(start: Column, end: Column, fps: Column, most: int = 20_000) -> Column:
    """start, start + 1/fps, ... up to the end, and the end itself; `most` at most."""
    n = F.least(F.floor((end - start) * fps).cast("int"), F.lit(most - 1))
    steps = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: start + i / fps)
    return F.when(end >= start, F.slice(F.array_union(steps, F.array(end)), 1, most)).otherwise(F.array().cast("array<double>"))


def last_n_at(cutoffs: DataFrame, items: DataFrame, on: Sequence[str], cutoff: str, at: str, item_id: str, n: int, out: str, parts: int | None = None) -> DataFrame:
    """For each cutoff the last `n` item ids at or before it, oldest first.

    Items and cutoffs are merged in one sort by key and time and a running window of `n` items is carried along, so items
    aren't multiplied by cutoffs. `parts` deals the keys to so many tasks, where cutoffs carry much along: a task sorts its part twice in memory.
    """
    row = items.select(*on, F.col(at).cast("double").alias("_t"), F.lit(0).alias("_side"), F.col(item_id).cast("string").alias("_id"), F.lit(None).cast(cutoffs.select(F.struct("*")).schema[0].dataType).alias("_cut"))
    ask = cutoffs.select(*on, F.col(cutoff).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_id"), F.struct("*").alias("_cut"))
    both = row.unionByName(ask)
    both = both if parts is None else both.repartition(parts, *on)
    order = Window.partitionBy(*on).orderBy("_t", "_side", "_id")
    both = both.withColumn("_k", F.count("_id").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = Window.partitionBy(*on).orderBy("_k").rangeBetween(-(n - 1), 0)
    got = both.withColumn(out, F.transform(F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_t", "_id"))).over(ranked)), lambda x: x["_id"])).where("_side = 1")
    return got.select(*[F.col("_cut")[c].alias(c) for c in cutoffs.columns], out)


def rounded_distinct(df: DataFrame, key: Sequence[str], cutoff: str, digits: int = 1) -> DataFrame:
    """One row for each key and cutoff rounded half to even, the first by cutoff."""
    r = F.bround(cutoff, digits)
    return df.withColumn("_r", r).withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_r").orderBy(cutoff))).where("_n = 1").drop("_r", "_n")


def uniform_grid(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Keys with three rows or more whose durations are all equal and whose gaps are all equal: `is_grid`."""
    w = Window.partitionBy(*key).orderBy(start)
    gaps = df.withColumns({"_d": F.round(F.col(end) - F.col(start), 3), "_g": F.round(F.lead(start).over(w) - F.col(start), 3)})
    out = gaps.groupBy(*key).agg(F.count("*").alias("n_rows"), F.countDistinct("_d").alias("_nd"), F.countDistinct("_g").alias("_ng"))
    return out.select(*key, "n_rows", ((F.col("n_rows") >= 3) & (F.col("_nd") == 1) & (F.col("_ng") == 1)).alias("is_grid"))


def enrich_phases(df: DataFrame, key: Sequence[str], kind: str, order: str, phase_id: str) -> DataFrame:
    """Index, round number within the kind, and ids before and after."""
    w = Window.partitionBy(*key).orderBy(order)
    by_kind = Window.partitionBy(*key, kind).orderBy(order)
    return df.withColumns({"phase_index": F.row_number().over(w) - 1, "round_in_kind": F.row_number().over(by_kind), "previous_phase_id": F.lag(phase_id).over(w), "next_phase_id": F.lead(phase_id).over(w)})


def vote_ticks(windows: DataFrame, key: Sequence[str], label: str, weight: Column, span: tuple[str, str], tick: float, order: Sequence[str]) -> DataFrame:
    """Weighted vote of the windows over the middle of each tick: label, share; ties go to the label seen first.

    A window names the ticks whose middle it covers by itself, so nothing is joined; ticks begin at 0. Rows of null key or span vote nowhere.
    """
    first, last = (F.floor(F.col(c) / tick).cast("int") for c in span)
    rows = windows.where(F.col(span[1]) > F.col(span[0])).dropna(subset=list(key)).where(last >= 0)
    met = rows.withColumn("tick", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn("_mid", (F.col("tick") + 0.5) * tick)
    met = met.where((F.col(span[0]) <= F.col("_mid")) & (F.col("_mid") < F.col(span[1])))
    votes = met.groupBy(*key, "tick", label).agg(F.sum(F.greatest(F.lit(0.1), weight)).alias("_score"), F.min(F.struct(*order)).alias("_first"))
    best = votes.groupBy(*key, "tick").agg(F.min_by(label, F.struct(-F.col("_score"), F.col("_first"))).alias(label), F.max("_score").alias("_s"), F.sum("_score").alias("_t"))
    return best.select(*key, "tick", label, F.round(F.col("_s") / F.col("_t"), 3).alias("share"))


def clip_span(at: Column, before: float, after: float, start: Column, end: Column, least: float = 0.5) -> Column:
    """struct(start_sec, end_sec) round a time, inside [start, end], at least `least` long."""
    s = F.greatest(start, at - before)
    return F.struct(s.alias("start_sec"), F.greatest(F.least(end, at + after), s + least).alias("end_sec"))


def tail(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def first_state(df: DataFrame, key: Sequence[str], at: str, state: str, wanted: str) -> DataFrame:
    """The first time that each key shows the wanted state."""
    return df.groupBy(*key).agg(F.min(F.when(F.col(state) == wanted, F.col(at))).alias("first_at"))


def entry_bounds(df: DataFrame, key: Sequence[str], at: str, state: str, before: str, after: str) -> DataFrame:
    """The first time of `after`, and the last time of `before` ahead of it."""
    first = df.groupBy(*key).agg(F.min(F.when(F.col(state) == after, F.col(at))).alias("after_at"))
    seen = df.where(F.col(state) == before).join(first, list(key), "right").where(F.col(at).isNull() | (F.col(at) < F.col("after_at")) | F.col("after_at").isNull())
    return first.join(seen.groupBy(*key).agg(F.max(F.when(F.col(at) < F.col("after_at"), F.col(at))).alias("before_at")), list(key), "left").select(*key, "before_at", "after_at")
