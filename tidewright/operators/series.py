"""Series of numbers longer than a row: (key, at, value) with `at` from 0, in blocks of arrays; samples that are missing count as 0.

Correlation is overlap-save on both sides: a block of the longer series with the block after it meets each block of the shorter one in
one small FFT, products of the same place add up, and the place of the largest is an aggregate. Nothing but a block or two is ever in a
task, however long the series are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import signals
from tidewright.scratch import Scratch


def in_blocks(df: DataFrame, key: Sequence[str], at: str, value: str, size: int) -> DataFrame:
    """(key, block, samples): arrays of `size` doubles; blocks without samples have no row. Of samples at one place the sum counts."""
    once = df.where(F.col(at) >= 0).groupBy(*key, F.col(at).cast("long").alias("_at")).agg(F.sum(F.col(value).cast("double")).alias("_v"))
    place = F.struct((F.col("_at") % size).cast("int").alias("i"), F.coalesce("_v", F.lit(0.0)).alias("v"))
    held = once.groupBy(*key, F.floor(F.col("_at") / size).alias("block")).agg(F.map_from_entries(F.collect_list(place)).alias("_m"))
    return held.select(*key, "block", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("samples"))


def envelope(df: DataFrame, key: Sequence[str], at: str, value: str, frame: int) -> DataFrame:
    """(key, at, value): change of the root mean square from frame to frame, in standard deviations; a last part of a frame is left out."""
    frames = df.groupBy(*key, F.floor(F.col(at) / frame).alias("at")).agg(F.sqrt(F.avg(F.pow(F.col(value).cast("double"), 2))).alias("_e"), F.count("*").alias("_n")).where(F.col("_n") == frame)
    along = Window.partitionBy(*key).orderBy("at")
    change = frames.withColumn("_c", F.coalesce(F.col("_e") - F.lag("_e").over(along), F.lit(0.0)))
    spread = change.groupBy(*key).agg(F.avg("_c").alias("_m"), F.stddev_pop("_c").alias("_s"))
    return change.join(spread, list(key)).select(*key, "at", ((F.col("_c") - F.col("_m")) / F.when(F.col("_s") > 1e-8, F.col("_s")).otherwise(1.0)).alias("value"))


def _lengths(df: DataFrame, key: Sequence[str], at: str, name: str) -> DataFrame:
    return df.where(F.col(at) >= 0).groupBy(*key).agg((F.max(F.col(at).cast("long")) + 1).alias(name))


def correlate(search: DataFrame, query: DataFrame, key: Sequence[str], at: str = "at", value: str = "value", size: int = 1 << 15) -> DataFrame:
    """(key, position, score): where each key's query fits its search series best - the first place of the largest sum of products, to six
    digits - and the cosine there (0 where either side is all zero). Keys whose query is longer than the series have position -1.
    """
    with Scratch(search.sparkSession) as scratch:
        s = scratch.staged(in_blocks(search, key, at, value, size), "search")
        q = scratch.staged(in_blocks(query, key, at, value, size).withColumnRenamed("samples", "part").withColumnRenamed("block", "_k"), "query")
        lengths = scratch.staged(_lengths(query, key, at, "_m").join(_lengths(search, key, at, "_n"), list(key), "left"), "lengths")
        zeros = F.array_repeat(F.lit(0.0), size)
        # A window needs its block and the one after; either may be missing, so blocks go to their own window and to the one before.
        sides = s.select(*key, F.explode(F.array(F.struct(F.col("block").alias("w"), F.lit(0).alias("half")), F.struct((F.col("block") - 1).alias("w"), F.lit(1).alias("half")))).alias("x"), "samples")
        pair = lambda half: F.coalesce(F.max(F.when(F.col("x.half") == half, F.col("samples"))), zeros)
        windows = sides.groupBy(*key, F.col("x.w").alias("_w")).agg(F.concat(pair(0), pair(1)).alias("window"))
        met = windows.join(q, list(key)).withColumn("block", F.col("_w") - F.col("_k")).join(lengths, list(key)).where("block * {0} <= _n - _m and block > -1".format(size))

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = b.column("window").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * size)
                p = b.column("part").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                out = np.fft.irfft(np.fft.rfft(w, axis=1) * np.conj(np.fft.rfft(p, 2 * size, axis=1)), 2 * size, axis=1)[:, :size]
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size, dtype=np.int32)), pa.array(np.ascontiguousarray(out).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), b.column("block"), values], names=[*key, "block", "values"])

        kinds = ", ".join(f"{k} {search.schema[k].dataType.simpleString()}" for k in key)
        parts = met.select(*key, "block", "window", "part").mapInArrow(products, f"{kinds}, block long, values array<double>")
        each = parts.select(*key, "block", F.posexplode("values").alias("i", "v")).groupBy(*key, (F.col("block") * size + F.col("i")).alias("position")).agg(F.round(F.sum("v"), 6).alias("v"))
        best = each.join(lengths, list(key)).where("position <= _n - _m").groupBy(*key, "_m").agg(F.max(F.struct("v", (-F.col("position")).alias("p"))).alias("best")).select(*key, "_m", F.col("best.v").alias("v"), (-F.col("best.p")).alias("position"))
        # What lies in the window found, in the blocks that it touches.
        touched = best.withColumn("block", F.explode(F.sequence(F.floor(F.col("position") / size), F.floor((F.col("position") + F.col("_m") - 1) / size))))
        low, high = F.greatest(F.col("position") - F.col("block") * size, F.lit(0)), F.least(F.col("position") + F.col("_m") - F.col("block") * size, F.lit(size))
        square = lambda values: F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x)
        energy = touched.join(s, [*key, "block"]).groupBy(*key).agg(F.sum(square(F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")))).alias("_es"))
        norms = q.groupBy(*key).agg(F.sum(square(F.col("part"))).alias("_eq"))
        found = lengths.join(best.drop("_m"), list(key), "left").join(energy, list(key), "left").join(norms, list(key), "left")
        scale = F.sqrt(F.coalesce("_es", F.lit(0.0))) * F.sqrt(F.coalesce("_eq", F.lit(0.0)))
        score = F.when(scale > 1e-8, F.col("v") / scale).otherwise(0.0)
        return scratch.kept(found.select(*key, F.coalesce("position", F.when(F.col("_m") <= F.col("_n"), 0).otherwise(-1)).cast("long").alias("position"), score.alias("score")), "correlated")


def cut(blocks: DataFrame, asks: DataFrame, key: Sequence[str], row_id: str, low: str, length: str, size: int, out: str) -> DataFrame:
    """(row_id, out): `length` samples of the key's series from `low` on, 0 where there are none. Pieces are a few blocks long."""
    first, last = F.floor(F.col(low) / size), F.floor((F.col(low) + F.col(length) - 1) / size)
    want = asks.select(*key, row_id, F.col(low).alias("_low"), F.col(length).alias("_len"), F.explode(F.sequence(first, last)).alias("block"))
    got = want.join(blocks, [*key, "block"], "left").withColumn("_s", F.coalesce("samples", F.array_repeat(F.lit(0.0), size)))
    whole = got.groupBy(row_id, "_low", "_len").agg(F.min("block").alias("_b"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "_s"))), lambda x: x["_s"])).alias("_all"))
    return whole.select(row_id, F.slice("_all", (F.col("_low") - F.col("_b") * size + 1).cast("int"), F.col("_len").cast("int")).alias(out))


def local_anchors(reference: DataFrame, target: DataFrame, key: Sequence[str], hz: float, spacing_sec: float, query_sec: float, radius_sec: float, delta_sec: float = 0.0, at: str = "at", value: str = "value", size: int = 1 << 15) -> DataFrame:
    """(key, reference_sec, target_sec, score): every `spacing_sec` a piece of the reference is sought near its place in the target.

    Only pieces whose search range holds `query_sec` of the target have a row.
    """
    step, m, r, shift = int(spacing_sec * hz), int(query_sec * hz), int(radius_sec * hz), int(delta_sec * hz)
    with Scratch(reference.sparkSession) as scratch:
        a, b = scratch.staged(in_blocks(reference, key, at, value, size), "reference"), scratch.staged(in_blocks(target, key, at, value, size), "target")
        n = _lengths(reference, key, at, "_n").join(_lengths(target, key, at, "_t"), list(key)).where(F.col("_n") >= m)
        pieces = n.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - m, F.lit(step).cast("long"))))
        pieces = pieces.withColumn("_from", F.greatest(F.lit(0), F.col("_at") + shift - r)).withColumn("_size", F.least(F.lit(m + 2 * r), F.col("_t") - F.col("_from"))).where(F.col("_size") >= m)
        pieces = scratch.staged(pieces.withColumns({"_m": F.lit(m), "_id": F.struct(*key, "_at")}), "pieces")
        asked = pieces.join(cut(a, pieces, key, "_id", "_at", "_m", size, "_q"), "_id").join(cut(b, pieces, key, "_id", "_from", "_size", size, "_s"), "_id")
        found = asked.withColumn("_f", signals.correlate("_s", "_q"))
        return scratch.kept(found.select(*key, (F.col("_at") / hz).alias("reference_sec"), ((F.col("_from") + F.col("_f.position")) / hz).alias("target_sec"), F.col("_f.score").alias("score")), "anchors")
