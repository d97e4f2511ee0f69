"""Joins on time and order: range, band, as-of, nearest, containment; and key joins that keep order or coverage.

Spark turns a join on inequalities alone into a nested loop. `range_join` cuts time into buckets and joins on those, which
hash-partitions both sides; a pair meets in one bucket alone (the later of the two starts), so nothing needs a distinct.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sweep import first_containing


def _buckets(start: Column, end: Column, width: float) -> Column:
    first, last = F.floor(start / width).cast("long"), F.floor(end / width).cast("long")
    return F.when(last >= first, F.sequence(first, last))


def range_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float, on: Sequence[str] = (), before: float = 0.0, after: float = 0.0, how: str = "inner") -> DataFrame:
    """Pairs whose spans meet: r.start <= l.end + after and r.end >= l.start - before, and equal `on` columns.

    `width` is the bucket size; take about the length of a widened span. Columns of both sides must differ but for `on`.
    Rows with null ends meet nothing. how: inner or left.
    """
    ls, le = F.col(left_span[0]) - before, F.col(left_span[1]) + after
    if how == "left":
        left = left.withColumn("_row", F.monotonically_increasing_id())
    l = left.withColumns({"_ls": ls, "_le": le}).withColumn("_b", F.explode(_buckets(F.col("_ls"), F.col("_le"), width)))  # noqa: E741
    r = right.withColumns({"_rs": F.col(right_span[0]), "_re": F.col(right_span[1])}).withColumn("_b", F.explode(_buckets(F.col("_rs"), F.col("_re"), width)))
    meet = l.join(r, [*on, "_b"]).where("_rs <= _le and _re >= _ls").where(F.col("_b") == F.floor(F.greatest("_ls", "_rs") / width))
    found = meet.drop("_ls", "_le", "_rs", "_re", "_b")
    if how == "inner":
        return found
    extra = [c for c in right.columns if c not in on]
    return left.join(found.select("_row", *extra), "_row", "left").drop("_row")


def asof_join(left: DataFrame, right: DataFrame, at: str, right_at: str, on: Sequence[str] = (), tolerance: float = 1e-6, order: Sequence[str] = ()) -> DataFrame:
    """Each left row with the latest right row at or before it (`tolerance` later at most); unmatched rows keep nulls.

    Rows of both sides are merged in one sort by key and time, and the last right row is carried forward: a shuffle of each
    side and no pairs. Of right rows of equal time the first by `order` is taken.
    """
    values = [c for c in right.columns if c not in on]
    known = right.withColumn("_rank", F.row_number().over(Window.partitionBy(*on, right_at).orderBy(*(order or values)))).where("_rank = 1")
    kept = F.struct(*[F.col(c) for c in values])
    r = known.select(*on, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), kept.alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    l = left.select(*on, (F.col(at) + tolerance).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left"))  # noqa: E741
    forward = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = r.unionByName(l).withColumn("_right", F.last("_right", ignorenulls=True).over(forward)).where("_side = 1")
    return joined.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_right")[c].alias(c) for c in values])


def next_join(left: DataFrame, right: DataFrame, at: str, right_at: str, on: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Each left row with the first right row after it, by time and then `order`; unmatched rows keep nulls.

    Both sides are merged in one sort from the back, along which the last right row is carried: no pairs.
    """
    values = [c for c in right.columns if c not in on]
    item = F.struct(*[F.col(c) for c in values])
    r = right.select(*on, F.col(right_at).alias("_t"), F.lit(1).alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], item.alias("_right"))
    l = left.select(*on, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.struct("*").alias("_left"))  # noqa: E741
    back = Window.partitionBy(*on).orderBy(F.desc("_t"), "_side", *[F.desc(f"_o{i}") for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    joined = r.where("_t is not null").unionByName(l, allowMissingColumns=True).withColumn("_right", F.last("_right", ignorenulls=True).over(back)).where("_side = 0")
    joined = joined.withColumn("_right", F.when(F.col("_t").isNotNull(), F.col("_right")))
    return joined.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_right")[c].alias(c) for c in values])


def next_other(left: DataFrame, right: DataFrame, at: str, right_at: str, owner: str, right_owner: str, horizon: float, on: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Each left row with the first right row, by time and then `order`, that comes after it, at most `horizon` later, and has another
    owner; left rows without one are dropped. Null owners are like no other and like each other.

    Whatever owner is excluded, one of two right rows is the answer: the nearest, or the nearest whose owner isn't that one's. Both are carried from the
    back, within buckets of the horizon's length in which a right row appears twice at most: its own and the one before.
    """
    values = [c for c in right.columns if c not in on]
    bucket = F.floor(F.col(right_at) / horizon)
    r = right.where(F.col(right_at).isNotNull()).select(*on, F.explode(F.array(bucket, bucket - 1)).alias("_b"), F.col(right_at).alias("_t"), F.lit(1).alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(F.col(right_owner).alias("_who"), *values).alias("_near"))
    l = left.where(F.col(at).isNotNull()).select(*on, F.floor(F.col(at) / horizon).alias("_b"), F.col(at).alias("_t"), F.lit(0).alias("_side"), F.col(owner).alias("_mine"), F.struct(*left.columns).alias("_left"))  # noqa: E741
    backwards = Window.partitionBy(*on, "_b").orderBy(F.desc("_t"), "_side", *[F.desc(f"_o{i}") for i in range(len(order))])
    so_far = backwards.rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l, allowMissingColumns=True)
    # The right row nearest so far before this row; where its owner differs from this right row's, it is the nearest of another.
    both = both.withColumn("_last", F.last("_near", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1)))
    both = both.withColumn("_turn", F.when((F.col("_side") == 1) & F.col("_last").isNotNull() & ~F.col("_last._who").eqNullSafe(F.col("_near._who")), F.col("_last")))
    both = both.withColumns({"_one": F.last("_near", ignorenulls=True).over(so_far), "_two": F.last("_turn", ignorenulls=True).over(so_far)}).where("_side = 0")
    found = both.withColumn("_found", F.when(~F.col("_one._who").eqNullSafe(F.col("_mine")), F.col("_one")).otherwise(F.col("_two")))
    found = found.where(F.col("_found").isNotNull() & (F.col(f"_found.{right_at}") - F.col("_t") <= horizon))
    return found.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_found")[c].alias(c) for c in values])


def previous_state(df: DataFrame, key: Sequence[str], order: Sequence[str], state: str, out: str = "previous") -> DataFrame:
    """The nearest earlier non-null state of each row's key."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(state, ignorenulls=True).over(w))


def nearest_interval(points: DataFrame, spans: DataFrame, at: str, span: tuple[str, str], on: Sequence[str], point_id: str, order: Sequence[str]) -> DataFrame:
    """Each point with the span of its key at the least distance, 0 inside; ties by `order`.

    Only three spans can be nearest: the one that reaches furthest of those begun, and those at either side; they come from
    running maxima and minima, so no pairs are made.
    """
    start, end = span
    values = [c for c in spans.columns if c not in on]
    item = F.struct(F.col(end).alias("_end"), *[(-F.col(c) if dict(spans.dtypes)[c] in ("int", "bigint", "double", "float") else F.col(c)).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*values).alias("_span"))
    rows = spans.select(*on, F.col(start).alias("_t"), F.lit(0).alias("_side"), item.alias("_item"), F.struct(*values).alias("_span"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_point"))
    asked = points.select(*on, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(rows.schema["_item"].dataType).alias("_item"), F.lit(None).cast(rows.schema["_span"].dataType).alias("_span"), F.struct("*").alias("_point"))
    merged = rows.unionByName(asked)
    past = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    # Ahead: the first span after the point, carried from the back; of equal starts the first by `order` comes last there.
    ahead = Window.partitionBy(*on).orderBy(F.desc("_t"), "_side", *[F.desc(f"_span.{c}") for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumns({"_before": F.max("_item").over(past)["_span"], "_after": F.last("_span", ignorenulls=True).over(ahead)}).where("_side = 1")
    distance = lambda s: F.greatest(F.col(f"{s}.{start}") - F.col("_t"), F.col("_t") - F.col(f"{s}.{end}"), F.lit(0.0))
    b, a = distance("_before"), distance("_after")
    best = F.when(F.col("_after").isNull() | (b <= a), F.col("_before")).otherwise(F.col("_after"))
    found = found.withColumns({"_best": F.when(F.col("_before").isNull(), F.col("_after")).otherwise(best)})
    return found.select(*[F.col("_point")[c].alias(c) for c in points.columns], *[F.col("_best")[c].alias(c) for c in values], F.when(F.col("_best").isNotNull(), F.greatest(F.col("_best")[start] - F.col("_t"), F.col("_t") - F.col("_best")[end], F.lit(0.0))).alias("distance"))


def containment_join(children: DataFrame, parents: DataFrame, child_span: tuple[str, str], parent_span: tuple[str, str], on: Sequence[str], child_id: str, parent_id: str, prefer: Sequence[Column]) -> DataFrame:
    """Each child with the first parent by `prefer`, then by id, that contains it (nulls, if none does): see `sweep`."""
    found = first_containing(children, parents, child_span, parent_span, on, child_id, parent_id, prefer)
    return children.join(found, child_id, "left").join(parents.drop(*on), parent_id, "left")


def point_in_interval(points: DataFrame, spans: DataFrame, at: str, span: tuple[str, str], on: Sequence[str], point_id: str, span_id: str, order: Sequence[str]) -> DataFrame:
    """Each point with the first span by `order`, then by id, that has start <= point < end; points without one are dropped."""
    found = first_containing(points, spans, (at, at), span, on, point_id, span_id, [F.col(c) for c in order], beyond=True)
    return points.join(found, point_id).join(spans.drop(*on), span_id)


def band_join(left: DataFrame, right: DataFrame, left_end: str, right_start: str, least: float, most: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs with least <= right_start - left_end <= most, and the gap."""
    l = left.withColumns({"_lo": F.col(left_end) + least, "_hi": F.col(left_end) + most})  # noqa: E741
    met = range_join(l, right, ("_lo", "_hi"), (right_start, right_start), max(most - least, 1e-6), on)
    return met.withColumn("gap", F.col(right_start) - F.col(left_end)).where((F.col("gap") >= least) & (F.col("gap") <= most)).drop("_lo", "_hi")


def first_per(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first `n` rows of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def lookup(left: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[Column | str], how: str = "left") -> DataFrame:
    """A hash lookup in which the last duplicate of a key wins (`order` is the order of writing)."""
    last = [F.desc(c) if isinstance(c, str) else c.desc() for c in order]
    return left.join(first_per(right, key, last).drop(*[c for c in order if isinstance(c, str) and c not in key and c in left.columns]), list(key), how)


def reconcile(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that aren't in all of several tables: key, and a boolean column for each table."""
    marks = [df.select(key).distinct().withColumn(f"in_{name}", F.lit(True)) for name, df in sides.items()]
    out = marks[0]
    for mark in marks[1:]:
        out = out.join(mark, key, "full_outer")
    flags = {f"in_{name}": F.coalesce(F.col(f"in_{name}"), F.lit(False)) for name in sides}
    out = out.withColumns(flags)
    every = F.lit(True)
    for name in flags:
        every = every & F.col(name)
    return out.where(~every)


def expand_ids(df: DataFrame, ids: str, table: DataFrame, key: str, row_id: str, out: str) -> DataFrame:
    """An array of ids replaced by the rows they name, in their order; ids without a row are dropped."""
    each = df.select(row_id, F.posexplode(ids).alias("_pos", key))
    found = each.join(table, key).groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("_pos", F.struct(*table.columns).alias("row")))).alias("_rows"))
    return df.join(found, row_id, "left").withColumn(out, F.coalesce(F.transform("_rows", lambda r: r["row"]), F.array())).drop("_rows")


def anti_completed(tasks: DataFrame, responses: DataFrame, key: str = "task_key") -> DataFrame:
    """Tasks without a response of status ok or skipped."""
    return tasks.join(responses.where(F.col("status").isin("ok", "skipped")).select(key), key, "left_anti")


def graded_match(df: DataFrame, levels: Sequence[tuple[str, DataFrame, Sequence[str]]], out: str = "status") -> DataFrame:
    """The first level whose table has the row's key: (name, table, key columns), strictest first; "none" if no level has."""
    status = F.lit("none")
    for i, (name, table, key) in reversed(list(enumerate(levels))):
        df = df.join(table.select(*key).distinct().withColumn(f"_hit{i}", F.lit(True)), list(key), "left")
        status = F.when(F.col(f"_hit{i}"), name).otherwise(status)
    return df.withColumn(out, status).drop(*[f"_hit{i}" for i in range(len(levels))])


def overlay(rows: DataFrame, patches: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields of a patch replace those of the row where they aren't null; other columns never change."""
    named = patches.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    out = rows.join(named, key, "left")
    return out.withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).drop(*[f"_new_{f}" for f in fields])


def cover_once(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Keys that break exactly-once coverage: key, code (missing, unexpected, duplicate)."""
    counts = decisions.groupBy(key).agg(F.count("*").alias("_n"))
    both = rows.select(key).distinct().withColumn("_row", F.lit(True)).join(counts, key, "full_outer")
    code = F.when(F.col("_row").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
    return both.select(key, code.alias("code")).where("code is not null")


def remap(rows: DataFrame, ids: DataFrame, key: str, new_key: str, child: str | None = None) -> DataFrame:
    """Rewrites `key` by a map (key, new_key) and the prefix of `child`; rows without an entry are dropped."""
    out = rows.join(ids.select(key, F.col(new_key).alias("_new")), key)
    if child:
        out = out.withColumn(child, F.concat(F.col("_new"), F.substring(F.col(child), F.length(key) + 1, F.length(child))))
    return out.withColumn(key, F.col("_new")).drop("_new")


def grid(*tables: DataFrame, most: int = 10_000) -> DataFrame:
    """Every combination of one large table (the first) with dimension tables. One of `most` rows or fewer is broadcast;
    a longer one is cut into numbered blocks of that size, which are broadcast one after another."""
    out = tables[0]
    for t in tables[1:]:
        if t.limit(most + 1).count() <= most:
            out = out.crossJoin(F.broadcast(t))
            continue
        rows = t.count()
        dealt = t.withColumn("_deal", F.pmod(F.xxhash64(*t.columns), F.lit(-(-2 * rows // most))))
        parts = [out.crossJoin(F.broadcast(dealt.where(F.col("_deal") == i).drop("_deal"))) for i in range(-(-2 * rows // most))]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        out = whole
    return out


def dots(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vec: str, right_vec: str, block_rows: int = 256) -> DataFrame:
    """(left_id, right_id, dot) of every pair of rows: `numbers.dot`, whose sums run in the order of places, over blocks of vectors at once.

    Both sides are dealt by hash into blocks of about `block_rows` rows, and a pair of blocks is one row: what moves is blocks, not pairs. Vectors that are null, hold nulls or differ
    in length give null.
    """
    def packed(df: DataFrame, row_id: str, vec: str, name: str) -> DataFrame:
        n = max(1, -(-df.count() // block_rows))
        return df.groupBy(F.pmod(F.xxhash64(row_id), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct(F.col(row_id).alias("id"), F.col(vec).cast("array<double>").alias("v"))).alias(name)).drop("_b")

    def matrix(vectors: list) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([-1 if v is None or None in v else len(v) for v in vectors])
        out = np.zeros((len(vectors), max(0, size.max(initial=0))))
        for i, v in enumerate(vectors):
            if size[i] > 0:
                out[i, : size[i]] = v
        return out, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (l, ls), (r, rs) = (matrix(b.column(c)[i].values.field("v").to_pylist()) for c in (0, 1))  # noqa: E741
                total = np.zeros((len(l), len(r)))
                with np.errstate(all="ignore"):
                    for k in range(min(l.shape[1], r.shape[1])):
                        total += l[:, k, None] * r[None, :, k]
                known = (ls[:, None] == rs[None, :]) & (ls[:, None] >= 0)
                li, ri = (b.column(c)[i].values.field("id") for c in (0, 1))
                at = np.arange(total.size)
                yield pa.RecordBatch.from_arrays([li.take(pa.array(at // len(r))), ri.take(pa.array(at % len(r))), pa.array(total.ravel(), mask=~known.ravel())], names=[left_id, right_id, "dot"])

    pairs = grid(packed(left, left_id, left_vec, "_l"), packed(right, right_id, right_vec, "_r"), most=200)
    kinds = [dict(df.dtypes)[c] for df, c in ((left, left_id), (right, right_id))]
    return pairs.mapInArrow(run, f"{left_id} {kinds[0]}, {right_id} {kinds[1]}, dot double")
