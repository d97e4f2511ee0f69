"""Order-dependent folds: first match wins, and what is matched changes as rows join it.

No relational rewrite exists for these in general. Sorted rows are packed into blocks of bounded size, and a block is folded from
the state that the rows before it leave (`blocks`): by speculation for `merge_events`, by composed maps for `merge_claims`. Scans that keep
little for each key stream through sorted partitions (`_stream`).
"""

from __future__ import annotations

import bisect
import itertools
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.scratch import Scratch

from .blocks import Blocks, differs, each, rows_of
from .joins import first_per


def _stream(df: DataFrame, key: Sequence[str], names: Sequence[str], order: Sequence[str], schema: str, fold: Callable[[], object]) -> DataFrame:
    """Rows of each key in order through a fold of their own: `feed(rows)` gives rows at once, or null.

    Sorted partitions stream past, many keys to a batch; a key that a batch cuts goes on in the next with the same fold.
    """
    keys = list(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for rows in batches:
            if not len(rows):
                continue
            parts = rows[keys]
            new = ((parts != parts.shift()) & ~(parts.isna() & parts.shift().isna())).any(axis=1).to_numpy()
            new[0] = False
            edges = [0, *np.flatnonzero(new).tolist(), len(rows)]
            out = []
            for a, b in zip(edges, edges[1:]):
                own = tuple(None if pd.isna(v) else v for v in parts.iloc[a])
                if state is None or own != held:
                    held, state = own, fold()
                found = state.feed(rows.iloc[a:b])
                if found is not None and len(found):
                    out.append(found)
            if out:
                yield pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]

    return df.select(*names).repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


class Merge:
    """The first kept interval that each interval merges into, else itself; kept ones grow as they take others.

    Two merge if their overlap is more than `iou` of their hull, or both ends lie within `edge_sec`. Rows come in order of
    start, so a kept interval that has ended, and began more than `edge_sec` ago, can't match again and is let go.
    """

    def __init__(self, edge_sec: float = 3.0, iou: float = 0.5):
        self.edge_sec, self.iou = edge_sec, iou
        self.live: list[list] = []  # low, high, id

    def __call__(self, ids: list, start: list[float], end: list[float]) -> list:
        out, edge, iou = [], self.edge_sec, self.iou
        for one, s, e in zip(ids, start, end):
            if self.live and any(x[1] <= s and x[0] < s - edge for x in self.live):
                self.live = [x for x in self.live if x[1] > s or x[0] >= s - edge]
            for x in self.live:
                lo, hi, _ = x
                hull = max(hi, e) - min(lo, s)
                if (abs(lo - s) <= edge and abs(hi - e) <= edge) or (hull > 0 and (min(hi, e) - max(lo, s)) / hull > iou):
                    x[0], x[1] = min(lo, s), max(hi, e)
                    out.append(x[2])
                    break
            else:
                self.live.append([s, e, one])
                out.append(one)
        return out


def _runs(block: dict) -> Iterator[tuple[int, int]]:
    """Where each key's rows begin and end in a packed block."""
    edges = [*block["cuts"], len(block["ids"])]
    yield from zip(edges, edges[1:])


def _timed(df: DataFrame, times: Sequence[str]) -> Column:
    """Whether a row has all its times; one that lacks some keeps to itself."""
    known = F.lit(True)
    for t in times:
        known = known & F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))
    return known


def merge_events(df: DataFrame, key: Sequence[str], start: str, end: str, row_id: str, order: Sequence[str], edge_sec: float = 3.0, iou: float = 0.5, block_rows: int = 262_144) -> DataFrame:
    """(row_id, kept_id) of events with equal keys that overlap or lie close, first match wins; `order` begins with `start`.

    A row without one of its times keeps to itself. The state is the live intervals (`Merge`), which a block takes over from the one before by speculation: see `blocks`.
    Where events lie so close that a block is shorter than they are, each block waits for the one before it, and a round costs far more than the
    rows folded in it: so blocks are long (some 30 MB as Python numbers), and rounds few.
    """
    kind = df.schema[row_id].dataType.simpleString()

    def merged(block: dict, entry: list) -> tuple[list, list]:
        kept, fold = [], None
        for a, b in _runs(block):
            fold = Merge(edge_sec, iou)
            fold.live = [[x["low"], x["high"], x["id"]] for x in entry] if not a else []
            kept += fold(block["ids"][a:b], block["c0"][a:b], block["c1"][a:b])
        return kept, [{"low": lo, "high": hi, "id": one} for lo, hi, one in fold.live]

    with Scratch(df.sparkSession) as scratch:
        known = _timed(df, [start, end])
        packed = Blocks(scratch, df.where(known), key, order, [start, end], row_id, block_rows)
        alive = lambda left, first: F.filter(left, lambda x: (x["high"] > first) | (x["low"] >= first - edge_sec))
        entries = packed.speculate(lambda block, entry: merged(block, entry)[1], alive, f"struct<low: double, high: double, id: {kind}>")
        found = packed.assigned(entries, lambda block, entry: merged(block, entry)[0], row_id)
        return scratch.kept(found.unionByName(df.where(~known).select(row_id, F.col(row_id).alias("kept_id"))), "merged")


class FirstMap:
    """What a run of rows makes of the first row of the group that is open before it: a step function of that row's time.

    at: times at which steps begin; `time` and `id` of the first row of the group open after the run, one more than `at`. A null
    time stands for the group that was open before: no row of the run lies beyond its reach.
    """

    def __init__(self, at: list[float], time: list, ids: list):
        self.at, self.time, self.id = at, time, ids

    @classmethod
    def of(cls, start: list[float], ids: list, within: float) -> FirstMap:
        """The map of sorted rows: a group ends before the first row that begins more than `within` after its first."""
        s = np.asarray(start, float)
        after = np.searchsorted(s, s + within, side="right")
        last, n = np.arange(len(s)), len(s)
        for j in range(n - 1, -1, -1):
            k = after[j]
            while k < n and not s[k] - s[j] > within:  # sums and differences of doubles may round apart
                k += 1
            while k - 1 > j and s[k - 1] - s[j] > within:
                k -= 1
            if k < n:
                last[j] = last[k]
        # Row j opens a group for firsts before the least time from which it is within reach; rows of equal time share that.
        far = s - s[0] > within  # a first is at most the first row's time, so these lie beyond any
        heads, beyond = np.flatnonzero(np.append(True, s[1:] != s[:-1]) & ~far), np.flatnonzero(far)
        reached = np.array([_reach(t, within) for t in s[heads].tolist()])
        at, time, out = reached.tolist(), s[last[heads]].tolist(), [ids[j] for j in last[heads]]
        if len(beyond):
            return cls(at, [*time, float(s[last[beyond[0]]])], [*out, ids[last[beyond[0]]]])._short()
        return cls(at, [*time, None], [*out, None])._short()

    def _short(self) -> FirstMap:
        keep = [i for i in range(len(self.at)) if (self.time[i], self.id[i]) != (self.time[i + 1], self.id[i + 1])]
        return FirstMap([self.at[i] for i in keep], [*[self.time[i] for i in keep], self.time[-1]], [*[self.id[i] for i in keep], self.id[-1]])

    def __call__(self, first: float, one: object) -> tuple[float, object]:
        i = bisect.bisect_right(self.at, first)
        return (first, one) if self.time[i] is None else (self.time[i], self.id[i])

    def after(self, before: FirstMap) -> FirstMap:
        """This map applied to what `before` gives."""
        at, time, ids = list(before.at), [], []
        for t, one in zip(before.time[:-1], before.id[:-1]):
            t, one = self(t, one)
            time.append(t)
            ids.append(one)
        if before.time[-1] is not None:
            t, one = self(before.time[-1], before.id[-1])
            return FirstMap(at, [*time, t], [*ids, one])._short()
        # Only the last step hands a group through: there this map's own steps hold.
        low = before.at[-1] if before.at else float("-inf")
        i = bisect.bisect_right(self.at, low)
        return FirstMap([*at, *self.at[i:]], [*time, *self.time[i:]], [*ids, *self.id[i:]])._short()

    @property
    def constant(self) -> bool:
        return not self.at and self.time[0] is not None


def _reach(t: float, within: float) -> float:
    """The least first time from which a row at `t` isn't more than `within` away, by the arithmetic of the fold itself."""
    low = high = t - within
    step = np.spacing(max(abs(t), abs(within)))
    while t - low <= within:
        low -= step
    while t - high > within:
        high += step
    while low < (middle := low + (high - low) / 2) < high:
        low, high = (low, middle) if t - middle <= within else (middle, high)
    return high


_STEPS = "at array<double>, time array<double>"


def _first_entries(packed: Blocks, within: float) -> DataFrame:
    """(block, time, id): the first row of the group that is open before each block; blocks that begin a key have no row.

    A block's map is composed with that of the block before it, then with that of the two before those, and so on, until it
    no longer depends on what came before. Most maps don't from the start, since groups soon begin alike.
    """
    kind, scratch = packed.kind, packed.scratch
    schema = f"block long, {_STEPS}, id array<{kind}>"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in each(b):
                a, z = list(_runs(r))[-1]
                m = FirstMap.of(r["c0"][a:z], r["ids"][a:z], within)
                if a or not r["goes_on"]:  # the last key begins here: nothing is open before
                    m = FirstMap([], *([x] for x in (m.time[0], m.id[0])))
                yield _map_row(b, r["block"], m)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in each(b):
                yield _map_row(b, r["block"], FirstMap(r["at"], r["time"], r["id"]).after(FirstMap(r["at_2"], r["time_2"], r["id_2"])))

    def _map_row(b: pa.RecordBatch, block: int, m: FirstMap) -> pa.RecordBatch:
        ids = b.schema.field("ids" if "ids" in b.schema.names else "id").type
        return pa.RecordBatch.from_pylist([{"block": block, "at": m.at, "time": m.time, "id": m.id}], schema=pa.schema([("block", pa.int64()), ("at", pa.list_(pa.float64())), ("time", pa.list_(pa.float64())), ("id", ids)]))

    # maps: block, the map, and the block whose map comes next (null once the map is constant).
    done = (F.size("at") == 0) & F.get("time", F.lit(0)).isNotNull()
    first = packed.rows.join(packed.chain.select("block", "goes_on"), "block").mapInArrow(own, schema)
    maps = scratch.staged(first.join(packed.chain.select("block", "before"), "block").withColumn("before", F.when(~done, F.col("before"))), "maps_0")
    for n in range(1, 64):
        open_maps = maps.where("before is not null")
        if open_maps.isEmpty():
            break
        inner = maps.select(F.col("block").alias("before"), *[F.col(c).alias(f"{c}_2") for c in ("at", "time", "id")], F.col("before").alias("before_2"))
        met = open_maps.join(inner, "before")
        step = met.select("block", "at", "time", "id", "at_2", "time_2", "id_2").mapInArrow(composed, schema).join(met.select("block", F.col("before_2").alias("before")), "block")
        maps = scratch.staged(maps.where("before is null").unionByName(step.withColumn("before", F.when(~done, F.col("before")))), f"maps_{n}")
    left = maps.select(F.col("block").alias("before"), F.get("time", F.lit(0)).alias("time"), F.get("id", F.lit(0)).alias("id"))
    return packed.chain.where("goes_on").join(left, "before").select("block", "time", "id")


def merge_claims(df: DataFrame, key: Sequence[str], start: str, row_id: str, order: Sequence[str], within: float = 3.0, block_rows: int = 8192) -> DataFrame:
    """(row_id, kept_id): each row joins the open group of its key if the group's first row began within `within` seconds
    before it; else it opens the next. `order` begins with `start`; a row without a time keeps to itself.

    The state is the open group's first row. What a block makes of it is a step function (`FirstMap`), so states follow by composition.
    """

    def joined(block: dict, entry: list) -> list:
        kept = []
        for a, b in _runs(block):
            fold = FromFirst(within)
            if not a and entry:
                fold.first, fold.id = entry[0]["time"], entry[0]["id"]
            kept += fold(block["ids"][a:b], block["c0"][a:b])
        return kept

    with Scratch(df.sparkSession) as scratch:
        known = _timed(df, [start])
        packed = Blocks(scratch, df.where(known), key, order, [start], row_id, block_rows)
        firsts = _first_entries(packed, within).select("block", F.array(F.struct("time", "id")).alias("entry"))
        entries = packed.chain.select("block").join(firsts, "block", "left").withColumn("entry", F.coalesce("entry", F.array().cast(firsts.schema["entry"].dataType)))
        found = packed.assigned(entries, joined, row_id)
        return scratch.kept(found.unionByName(df.where(~known).select(row_id, F.col(row_id).alias("kept_id"))), "joined")


class FromFirst:
    """Each row joins the open group if its first row began within `within` seconds; else it opens the next group."""

    def __init__(self, within: float):
        self.within, self.first, self.id = within, None, None

    def __call__(self, ids: list, start: list[float]) -> list:
        out = []
        for one, s in zip(ids, start):
            if self.first is None or s - self.first > self.within:
                self.first, self.id = s, one
            out.append(self.id)
        return out


def fuse_by_anchor(df: DataFrame, key: Sequence[str], start: str, row_id: str, order: Sequence[str], tolerance: float = 1.5) -> DataFrame:
    """(row_id, kept_id): groups measured from their first row, not their last."""
    return merge_claims(df, key, start, row_id, order, tolerance)


def smooth_runs(df: DataFrame, key: Sequence[str], order: str, label: str, least: int) -> DataFrame:
    """`label` smoothed per key, in a column `smoothed`: the first run shorter than `least` takes the label before it, else the
    one after, then from the start again until no run changes; runs labelled "unknown" stay.

    What comes of that has a closed form. A long or unknown run keeps its label and hands it to the short runs behind it.
    The short runs at the head grow together until they are long or meet an unknown run, and take the label they end with.
    """
    w = Window.partitionBy(*key).orderBy(order)
    change = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    rows = df.select(*key, order, label).withColumn("_new", change).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    runs = rows.groupBy(*key, "_run").agg(F.count("*").alias("_n"), F.first(label).alias("_label"))
    along = Window.partitionBy(*key).orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    runs = runs.withColumn("_settled", (F.sum("_n").over(along) >= least) | (F.col("_label") == "unknown"))
    runs = runs.withColumn("_head", F.coalesce(F.min(F.when(F.col("_settled"), F.col("_run"))).over(whole), F.max("_run").over(whole)))
    keeps = (F.col("_run") >= F.col("_head")) & ((F.col("_run") == F.col("_head")) | (F.col("_n") >= least) | (F.col("_label") == "unknown"))
    own = F.when(keeps, F.col("_label"))
    head = F.max(F.when(F.col("_run") == F.col("_head"), F.col("_label"))).over(whole)
    runs = runs.withColumn("smoothed", F.when(F.col("_run") < F.col("_head"), head).otherwise(F.last(own, ignorenulls=True).over(along)))
    return rows.join(runs.select(*key, "_run", "smoothed"), [*key, "_run"]).drop("_run")


def timeline(groups: DataFrame, anchored: str, idx: str) -> DataFrame:
    """`timeline_index`: anchored groups keep their index, others follow after the largest, by their smallest member."""
    top = groups.where(anchored).agg(F.coalesce(F.max(idx), F.lit(-1)).alias("_top"))
    rank = F.row_number().over(Window.partitionBy(anchored).orderBy(idx))
    return groups.crossJoin(F.broadcast(top)).withColumn("timeline_index", F.when(F.col(anchored), F.col(idx)).otherwise(F.col("_top") + rank)).drop("_top")


def inlier_fit(x: np.ndarray, y: np.ndarray, pairs: Sequence[tuple[int, int]], threshold: float = 2.0, scales=(0.95, 1.05)) -> dict | None:
    """y = scale * x + offset: the least-squares fit of the inliers of the first line with the most, of lines through pairs of
    points; null under three inliers. One sequence at a time; `affine_fit` does the same in aggregates."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    best = np.zeros(len(x), bool)
    for i, j in pairs if len(x) >= 3 else ():
        if abs(x[j] - x[i]) < 1e-9:
            continue
        scale = (y[j] - y[i]) / (x[j] - x[i])
        if scales[0] <= scale <= scales[1]:
            near = np.abs(y - (scale * x + y[i] - scale * x[i])) <= threshold
            if near.sum() > best.sum():
                best = near
    if best.sum() < 3 or np.var(x[best]) * best.sum() <= 1e-9:
        return None
    bx, by = x[best], y[best]
    scale = ((bx - bx.mean()) * (by - by.mean())).sum() / ((bx - bx.mean()) ** 2).sum()
    offset = by.mean() - scale * bx.mean()
    left = np.sort(np.abs(by - (scale * bx + offset)))
    return {"scale": scale, "offset": offset, "anchor_count": len(x), "inlier_count": int(best.sum()), "median_residual_sec": float(np.median(left)), "p95_residual_sec": float(left[min(len(left) - 1, int(0.95 * len(left)))])}


def ransac(x: Sequence[float], y: Sequence[float], threshold: float = 2.0, rounds: int = 200, seed: int = 0, scales=(0.95, 1.05)) -> dict | None:
    """`inlier_fit` over seeded random pairs."""
    draw = random.Random(seed)
    return inlier_fit(x, y, [tuple(draw.sample(range(len(x)), 2)) for _ in range(rounds if len(x) >= 3 else 0)], threshold, scales)


def draw_order(hashes: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """A row of `rounds` ranks for each hash: the two rows of least rank in a round are that round's pair."""
    salt = (np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)
    h = hashes.astype(np.int64).view(np.uint64)[:, None] ^ salt[None, :]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D) >> np.uint64(1)


def _two_least(ranks: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank, x and y of the two rows of least rank in each round (column), the lesser first; a missing one has the greatest rank and no point."""
    rounds = np.arange(ranks.shape[1])
    if len(ranks) == 1:
        ranks, x, y = (np.concatenate([v, np.full((1, *v.shape[1:]), fill, v.dtype)]) for v, fill in ((ranks, np.iinfo(np.int64).max), (x, np.nan), (y, np.nan)))
    first = ranks.argmin(axis=0)
    least = ranks[first, rounds]
    ranks[first, rounds] = np.iinfo(np.int64).max
    second = ranks.argmin(axis=0)
    second = np.where(second == first, (first + 1) % len(ranks), second)  # all others have the greatest rank
    per_round = (lambda v, i: v[i]) if x.ndim == 1 else (lambda v, i: v[i, rounds])
    return np.stack([least, ranks[second, rounds]]), np.stack([per_round(x, first), per_round(x, second)]), np.stack([per_round(y, first), per_round(y, second)])


def _numbers(values: pa.Array, i: int) -> np.ndarray:
    return values[i].values.to_numpy(zero_copy_only=False)


def _folded(batches: Iterator[pa.RecordBatch], made: Callable[[pa.RecordBatch, int], tuple], merged: Callable[[tuple, tuple], tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What `made` gives for each row, merged while rows of one `k` follow each other: few rows a key and task."""
    held, state, out = None, None, []

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for b in batches:
        for i, k in enumerate(b.column("k").to_pylist()):
            new = made(b, i)
            if state is not None and k == held:
                state = merged(state, new)
                continue
            if state is not None:
                out.append((held, *[np.ravel(v) for v in state]))
            if len(out) >= 256:
                yield batch(out)
                out = []
            held, state = k, new
    if state is not None:
        yield batch([*out, (held, *[np.ravel(v) for v in state])])


def affine_fit(df: DataFrame, key: str, x: str, y: str, order: str, threshold: float = 2.0, rounds: int = 200, seed: int = 0, scales=(0.95, 1.05), block_rows: int = 4096) -> DataFrame:
    """A RANSAC fit for each key; keys without a fit are dropped.

    Pairs are drawn by hash. Rows lie in blocks of one key, `block_rows` at most; a block gives its two least rows of each round, and later
    how many of its rows lie near each line, and what blocks give is merged in the tasks before it is shuffled. Lines meet blocks, not rows,
    and no task sees all rows of a key. Rows with null x or y take no part.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.xxhash64(order).alias("h")).where("k is not null and x is not null and y is not null")
    highest = np.iinfo(np.int64).max

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in rows_of(batches, block_rows):
            cuts = np.append(np.flatnonzero(differs(t.column("k").combine_chunks())), t.num_rows)
            cut = lambda c: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), t.column(c).combine_chunks())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([t.column("k").combine_chunks().take(pa.array(cuts[:-1])), cut("x"), cut("y"), cut("h")], names=["k", "x", "y", "h"])

    def draw(b: pa.RecordBatch, i: int) -> tuple:
        return _two_least(draw_order(_numbers(b.column("h"), i), rounds, seed).astype(np.int64), _numbers(b.column("x"), i), _numbers(b.column("y"), i))

    def lesser(one: tuple, other: tuple) -> tuple:
        return _two_least(*[np.concatenate([a, b]) for a, b in zip(one, other)])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = pa.schema([("k", b.schema.field("k").type), ("rank", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64()))])
            break
        else:
            return
        yield from _folded(itertools.chain([b], batches), draw, lesser, kept)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                rank, px, py = _two_least(*[c.flatten().to_numpy(zero_copy_only=False).reshape(-1, rounds).copy() for c in b.column("parts")[i].values.flatten()])
                with np.errstate(all="ignore"):
                    slope = (py[1] - py[0]) / (px[1] - px[0])
                    fits = (rank[1] < highest) & (np.abs(px[1] - px[0]) >= 1e-9) & (slope >= scales[0]) & (slope <= scales[1])
                    out.append((slope[fits], (py[0] - slope * px[0])[fits]))
            yield pa.RecordBatch.from_arrays([b.column("k"), *[pa.array([o[j] for o in out], pa.list_(pa.float64())) for j in (0, 1)]], names=["k", "slope", "cut"])

    def near_lines(b: pa.RecordBatch, i: int) -> tuple:
        slope, cut, px, py = (_numbers(b.column(c), i) for c in ("slope", "cut", "x", "y"))
        return ((np.abs(py[:, None] - (slope * px[:, None] + cut)) <= threshold).sum(axis=0), np.array([len(px)]))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = pa.schema([("k", b.schema.field("k").type), ("n", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])
            break
        else:
            return
        yield from _folded(itertools.chain([b], batches), near_lines, lambda one, other: tuple(u + v for u, v in zip(one, other)), kept)

    with Scratch(df.sparkSession) as scratch:
        packed = rows.repartitionByRange("k", "h").sortWithinPartitions("k").mapInArrow(pack, f"k {kind}, x array<double>, y array<double>, h array<long>")
        blocks = scratch.staged(packed, "blocks")
        parts = blocks.mapInArrow(drawn, f"k {kind}, rank array<long>, x array<double>, y array<double>").groupBy("k").agg(F.collect_list(F.struct("rank", "x", "y")).alias("parts"))  # a part a task
        lines = scratch.staged(parts.mapInArrow(through, f"k {kind}, slope array<double>, cut array<double>").where(F.size("slope") > 0), "lines")
        votes = blocks.select("k", "x", "y").join(lines, "k").mapInArrow(voted, f"k {kind}, n array<long>, rows array<long>")
        total = votes.groupBy("k").agg(F.collect_list("n").alias("ns"), F.sum(F.get("rows", F.lit(0))).alias("rows"))
        summed = F.aggregate(F.slice("ns", 2, F.size("ns")), F.get("ns", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
        total = total.select("k", "rows", summed.alias("n")).withColumn("most", F.array_max("n")).where("most >= 3").withColumn("at", (F.array_position("n", F.col("most")) - 1).cast("int"))
        best = scratch.staged(lines.join(total, "k").select("k", F.struct(F.get("slope", "at").alias("slope"), F.get("cut", "at").alias("cut"), "rows").alias("l")), "best")
        points = blocks.join(best, "k").select("k", "l", F.inline(F.arrays_zip("x", "y")))
        near = points.where(F.abs(F.col("y") - (F.col("l.slope") * F.col("x") + F.col("l.cut"))) <= threshold)
        fit = near.groupBy("k").agg(F.regr_slope("y", "x").alias("scale"), F.regr_intercept("y", "x").alias("offset"), F.count("*").alias("inlier_count"), F.first("l.rows").alias("anchor_count"), F.var_pop("x").alias("spread"))
        fit = scratch.staged(fit.where(F.col("spread") * F.col("inlier_count") > 1e-9), "fit")
        left = near.join(fit.select("k", "scale", "offset", "inlier_count"), "k").select("k", "inlier_count", F.abs(F.col("y") - (F.col("scale") * F.col("x") + F.col("offset"))).alias("r"))
        ranked = left.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("r")) - 1)
        half = (F.col("i") == F.floor((F.col("inlier_count") - 1) / 2)) | (F.col("i") == F.floor(F.col("inlier_count") / 2))
        late = F.col("i") == F.least(F.col("inlier_count") - 1, F.floor(F.col("inlier_count") * 0.95))
        stats = ranked.groupBy("k").agg(F.avg(F.when(half, F.col("r"))).alias("median_residual_sec"), F.max(F.when(late, F.col("r"))).alias("p95_residual_sec"))
        return scratch.kept(fit.join(stats, "k").select(F.col("k").alias(key), "scale", "offset", "anchor_count", "inlier_count", "median_residual_sec", "p95_residual_sec"), "fits")


def select_distinct_capped(df: DataFrame, key: Sequence[str], order: Sequence[str], cap_key: Sequence[str], cap: int, limit: int) -> DataFrame:
    """In order: the first row of each key, at most `cap` of them for each cap key, `limit` in all. Keys hold the cap key's columns."""
    return first_per(first_per(df, key, order), cap_key, order, cap).orderBy(*order).limit(limit)


class _Scan:
    """A start opens an episode, an end at least `least_sec` later closes it, and nothing is looked at for `skip_sec` after that."""

    def __init__(self, key: str, at: str, kind: str, starts: Sequence[str], ends: Sequence[str], skip_sec: float, least_sec: float):
        self.key, self.at, self.kind, self.starts, self.ends, self.skip_sec, self.least_sec = key, at, kind, set(starts), set(ends), skip_sec, least_sec
        self.opened, self.ready, self.episodes = None, float("-inf"), 0

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        out, who = [], rows[self.key].iloc[0]
        for t, what in zip(rows[self.at].tolist(), rows[self.kind].tolist()):
            if t < self.ready:
                continue
            if self.opened is None and what in self.starts:
                self.opened = t
            elif self.opened is not None and what in self.ends and t - self.opened >= self.least_sec:
                out.append((who, self.episodes, self.opened, t))
                self.opened, self.ready, self.episodes = None, t + self.skip_sec, self.episodes + 1
        return pd.DataFrame(out, columns=[self.key, "episode", "start_sec", "end_sec"])


def boundary_scan(df: DataFrame, key: str, at: str, kind: str, starts: Sequence[str], ends: Sequence[str], skip_sec: float = 180.0, least_sec: float = 300.0) -> DataFrame:
    """A two-state scan for each key (`_Scan`): key, episode, start_sec, end_sec. Rows of equal time go by their kind."""
    schema = f"{key} {dict(df.dtypes)[key]}, episode long, start_sec double, end_sec double"
    rows = df.withColumn(at, F.col(at).cast("double"))
    return _stream(rows, [key], [key, at, kind], [at, kind], schema, lambda: _Scan(key, at, kind, starts, ends, skip_sec, least_sec))
