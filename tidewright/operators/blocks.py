"""Sorted rows in packed blocks, for folds whose state runs on from row to row.

`pack` range-partitions rows by key and order and packs each partition's sorted rows into blocks of a bounded number, one row
of arrays each; a block may hold many keys, and a key many blocks. A fold then is a map over blocks once the state is known
with which each block begins. That state comes from the block before - where it ends with the same key - in one of three ways:

* `speculate`: each block is folded from no state; a block is folded again from what the one before leaves only while that
  differs from what it was folded from. States of first-match folds are short-lived, so most blocks settle in the second
  round whatever the size. A round folds changed blocks alone and hands on states, not rows.
* `scan`: where what blocks leave adds up, sums of neighbours are added by doubling.
* maps: where a block's effect is a small function of the state it begins with, functions of neighbours are composed by
  doubling, in a number of rounds that is the logarithm of the number of blocks at most (`folds.merge_claims`).

Tasks hold a block and a state; a key's rows never meet in one task, and no round is bound to the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.scratch import Scratch

_FEW = 200  # numbers of blocks that a filter may name
_SHARE, _TASKS = 32, 64  # blocks a task, once there are more than so many tasks' worth


def differs(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it, nulls being equal to each other; true for the first."""
    if len(column) < 2:
        return np.ones(len(column), bool)
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
    return np.append(True, unequal | (now.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False)))


def rows_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The same rows in tables of `most` rows; the last has what is left."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, most - n)
            held.append(part)
            n, b = n + part.num_rows, b.slice(part.num_rows)
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def each(b: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows as dicts, made one at a time: a row is a block, and a batch may hold hundreds."""
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]


class Blocks:
    """Packed blocks of `df` in the shared folder.

    rows: block, ids, cuts (places where a key begins) and c0, c1, ..., the arrays of `columns` as doubles.
    chain: block, before (the block before it), goes_on (which ends with the key that this one begins with) and `first`, the
    first row's c0.
    """

    def __init__(self, scratch: Scratch, df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], row_id: str, block_rows: int = 8192):
        self.scratch, self.kind = scratch, df.schema[row_id].dataType.simpleString()
        keys = [f"k{i}" for i in range(len(key))]
        n = len(columns)
        rows = df.select(*[F.col(c).alias(k) for c, k in zip(key, keys)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], F.col(row_id).alias("id"))
        by = [*keys, *[f"o{i}" for i in range(len(order))]]
        sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, *[f"c{i}" for i in range(n)], "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for seq, t in enumerate(rows_of(batches, block_rows)):
                new = np.zeros(t.num_rows, bool)
                for k in keys:
                    new |= differs(t.column(k).combine_chunks())
                new[0] = True
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                out = [pa.array([part], pa.int32()), pa.array([part << 32 | seq], pa.int64()), *[flat(t.column(k)).slice(at, 1) for at in (0, t.num_rows - 1) for k in keys]]
                out += [one(pa.array(np.flatnonzero(new).astype(np.int32))), one(flat(t.column("id"))), *[one(flat(t.column(f"c{i}"))) for i in range(n)]]
                yield pa.RecordBatch.from_arrays(out, names=["part", "block", *[f"first_{k}" for k in keys], *[f"last_{k}" for k in keys], "cuts", "ids", *[f"c{i}" for i in range(n)]])

        types = {k: rows.schema[k].dataType.simpleString() for k in keys}
        schema = "part int, block long, " + "".join(f"{end}_{k} {types[k]}, " for end in ("first", "last") for k in keys) + f"cuts array<int>, ids array<{self.kind}>" + "".join(f", c{i} array<double>" for i in range(n))
        packed = scratch.staged(sorted_rows.mapInArrow(run, schema), "blocks")
        # A task's blocks may reach Python in one batch, so they are dealt out: a split of the files, or a partition put together by its size, holds too many.
        count = packed.count()
        self.rows = packed.select("block", "cuts", "ids", *[f"c{i}" for i in range(n)]).repartition(max(1, min(count, max(_TASKS, -(-count // _SHARE)))), "block")
        ends = packed.select("part", "block", F.struct(*[F.col(f"first_{k}") for k in keys]).alias("head"), F.struct(*[F.col(f"last_{k}").alias(f"first_{k}") for k in keys]).alias("tail"), F.get("c0", F.lit(0)).alias("first"))
        # Within a partition blocks are numbered; a partition's first follows the last of the nearest one before that has rows.
        last = ends.groupBy("part").agg(F.max("block").alias("block"))
        last = last.select((F.col("part").cast("long") * 2**32).alias("block"), F.lag("block").over(Window.orderBy("part")).alias("jump"))  # a row a partition
        linked = ends.join(last, "block", "left").withColumn("before", F.when(F.col("block") % 2**32 == 0, F.col("jump")).otherwise(F.col("block") - 1))
        before = ends.select(F.col("block").alias("before"), F.col("tail").alias("before_tail"))
        chain = linked.join(before, "before", "left").select("block", "before", F.coalesce(F.col("before").isNotNull() & F.col("head").eqNullSafe(F.col("before_tail")), F.lit(False)).alias("goes_on"), "first")
        self.chain = scratch.staged(chain, "chain")

    def speculate(self, fold: Callable[[dict, list], list], enter: Callable[[Column, Column], Column], state: str) -> DataFrame:
        """(block, entry): the state with which each block begins, an array<`state`>.

        `fold` gives the state after a block's rows (a dict) from the one before them; `enter` cuts what a block leaves to what the
        block that follows, which begins at `first`, can still meet.
        """
        kind = f"array<{state}>"

        def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in each(b):
                    out = {"block": r["block"], "entry": r["entry"], "exit": fold(r, r["entry"])}
                    yield pa.RecordBatch.from_pylist([out], schema=pa.schema([("block", pa.int64()), ("entry", b.schema.field("entry").type), ("exit", b.schema.field("entry").type)]))

        def folded(entries: DataFrame, rows: DataFrame) -> DataFrame:
            return rows.join(entries, "block").mapInArrow(leave, f"block long, entry {kind}, exit {kind}")

        none = F.array().cast(kind)
        # Blocks that no other follows leave a state for nobody, but settle like the rest.
        found = self.scratch.staged(folded(self.chain.select("block", none.alias("entry")), self.rows), "states_0")
        for n in range(1, 1 << 30):
            left = found.select(F.col("block").alias("before"), F.col("exit").alias("left"))
            due = self.chain.where("goes_on").join(left, "before").select("block", enter(F.col("left"), F.col("first")).alias("due"))
            changed = self.scratch.staged(found.join(due, "block").where(F.col("due") != F.col("entry")).select("block", F.col("due").alias("entry")), f"changed_{n}")
            few = [r.block for r in changed.select("block").limit(_FEW + 1).collect()]
            if not few:
                return found.select("block", "entry")
            # A state that runs on from block to block changes a few of them a round; named in a filter, the other files aren't read.
            again = folded(changed, self.rows.where(F.col("block").isin(few)) if len(few) <= _FEW else self.rows)
            found = self.scratch.staged(found.join(changed.select("block"), "block", "left_anti").unionByName(again), f"states_{n}")

    def scan(self, leave: Callable[[dict], list], merge: Callable[[list, list, float], list], state: str) -> DataFrame:
        """(block, entry): the state with which each block begins, an array<`state`>, where states add up.

        `leave` gives what a block's rows leave by themselves, `merge` adds what earlier rows left to what later ones did, given the last
        row's c0. Sums over runs of blocks are doubled in length until each reaches back to where its key begins.
        """
        kind = f"array<{state}>"

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [{"block": r["block"], "state": leave(r), "last": r["c0"][-1], "open": r["goes_on"] and len(r["cuts"]) == 1} for r in each(b)]
                yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("block", pa.int64()), ("state", b.schema.field("none").type), ("last", pa.float64()), ("open", pa.bool_())]))

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [{"block": r["block"], "state": merge(r["state_2"], r["state"], r["last"]), "last": r["last"], "before": r["before_2"]} for r in each(b)]
                yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("block", pa.int64()), ("state", b.schema.field("state").type), ("last", pa.float64()), ("before", pa.int64())]))

        first = self.rows.join(self.chain.select("block", "goes_on"), "block").withColumn("none", F.array().cast(kind)).mapInArrow(own, f"block long, state {kind}, last double, open boolean")
        sums = self.scratch.staged(first.join(self.chain.select("block", "before"), "block").select("block", "state", "last", F.when(F.col("open"), F.col("before")).alias("before")), "sums_0")
        for n in range(1, 64):
            open_sums = sums.where("before is not null")
            if open_sums.isEmpty():
                break
            earlier = sums.select(F.col("block").alias("before"), F.col("state").alias("state_2"), F.col("before").alias("before_2"))
            step = open_sums.join(earlier, "before").select("block", "state", "last", "state_2", "before_2").mapInArrow(added, f"block long, state {kind}, last double, before long")
            sums = self.scratch.staged(sums.where("before is null").unionByName(step), f"sums_{n}")
        left = self.chain.where("goes_on").join(sums.select(F.col("block").alias("before"), F.col("state").alias("entry")), "before").select("block", "entry")
        return self.chain.select("block").join(left, "block", "left").withColumn("entry", F.coalesce("entry", F.array().cast(kind)))

    def assigned(self, entries: DataFrame, fold: Callable[[dict, list], list], row_id: str) -> DataFrame:
        """(row_id, kept_id) of all rows, folded from each block's entry; `fold` gives the id that each row joins."""
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column("ids")
                for i, r in enumerate(each(b)):
                    yield pa.RecordBatch.from_arrays([ids[i].values, pa.array(fold(r, r["entry"]), ids.type.value_type)], names=["id", "kept"])

        rows = self.rows.join(entries, "block")
        return rows.mapInArrow(run, f"id {kind}, kept {kind}").select(F.col("id").alias(row_id), F.col("kept").alias("kept_id"))
