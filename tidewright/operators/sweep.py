"""Containment by a sweep in order of start with the open parents in hand.

Of the parents that began, only those matter that no other outlives and outranks: a child takes the first by rank that reaches its
end, so a parent that ends no later and ranks no better than another never is one's first. What is left, sorted by end, is sorted by rank
as well, and a child's parent is found by bisection. This frontier of open parents is what a block of sorted rows takes over from those
before it (`Blocks.scan`); its rows are the parents and children themselves, and no pair is ever formed.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.scratch import Scratch

from .blocks import Blocks


class Frontier:
    """Parents by end and, at once, by rank."""

    def __init__(self, entry: Sequence[dict] = ()):
        self.end, self.rank = [x["end"] for x in entry], [(tuple(x["rank"]), x["id"]) for x in entry]

    def add(self, end: float, rank: tuple) -> None:
        at = bisect.bisect_left(self.end, end)
        if at < len(self.end) and self.rank[at] <= rank:
            return
        low, high = at, at + (at < len(self.end) and self.end[at] == end)
        while low and self.rank[low - 1] > rank:
            low -= 1
        self.end[low:high], self.rank[low:high] = [end], [rank]

    def first(self, end: float, beyond: bool) -> object:
        """The best of those that end at `end` or later (after it, if `beyond`)."""
        at = (bisect.bisect_right if beyond else bisect.bisect_left)(self.end, end)
        return self.rank[at][1] if at < len(self.end) else None

    def open_at(self, start: float) -> list[dict]:
        at = bisect.bisect_left(self.end, start)
        return [{"end": e, "rank": list(r), "id": one} for e, (r, one) in zip(self.end[at:], self.rank[at:])]


def first_containing(children: DataFrame, parents: DataFrame, child_span: tuple[str, str], parent_span: tuple[str, str], on: Sequence[str], child_id: str, parent_id: str, rank: Sequence[Column], beyond: bool = False, block_rows: int = 8192) -> DataFrame:
    """(child_id, parent_id): for each child the first parent by `rank`, then by id, of equal `on` columns that begins with it or before and
    ends with it or after (after it alone, if `beyond`). Children without one have no row.

    Ranks are numbers of the parent's columns; ids are unique and not null; null keys are equal to each other. Spans with a null or NaN end, or that end before they begin,
    hold nothing and lie in nothing.
    """
    ranks = [f"_r{i}" for i in range(len(rank))]
    whole = lambda span: (F.col(span[0]) <= F.col(span[1])) & ~F.isnan(F.col(span[1]).cast("double"))
    p = parents.where(whole(parent_span)).select(*on, F.col(parent_span[0]).alias("_s"), F.col(parent_span[1]).alias("_e"), F.lit(0).alias("_side"), *[c.cast("double").alias(r) for c, r in zip(rank, ranks)], F.col(parent_id).alias("_p"))
    c = children.where(whole(child_span)).select(*on, F.col(child_span[0]).alias("_s"), F.col(child_span[1]).alias("_e"), F.lit(1).alias("_side"), *[F.lit(None).cast("double").alias(r) for r in ranks], F.col(child_id).alias("_c"))
    rows = p.unionByName(c, allowMissingColumns=True).withColumn("_id", F.struct(F.col("_c").alias("child"), F.col("_p").alias("parent")))

    def swept(block: dict, entry: list) -> tuple[list, list]:
        kept, front = [], Frontier(entry)
        starts = set(block["cuts"][1:])
        for i, (one, e, side, *r) in enumerate(zip(block["ids"], block["c1"], block["c2"], *[block[f"c{3 + k}"] for k in range(len(ranks))])):
            if i in starts:
                front = Frontier()
            if side:
                kept.append({"child": one["child"], "parent": front.first(e, beyond)})
            else:
                front.add(e, (tuple(r), one["parent"]))
                kept.append(None)
        return kept, front.open_at(block["c0"][-1])

    def merge(earlier: list, later: list, last: float) -> list:
        front = Frontier(later)
        for x in earlier:
            front.add(x["end"], (tuple(x["rank"]), x["id"]))
        return front.open_at(last)

    with Scratch(children.sparkSession) as scratch:
        packed = Blocks(scratch, rows, on, ["_s", "_side"], ["_s", "_e", "_side", *ranks], "_id", block_rows)
        entries = packed.scan(lambda block: swept(block, [])[1], merge, f"struct<end: double, rank: array<double>, id: {rows.schema['_p'].dataType.simpleString()}>")
        found = packed.assigned(entries, lambda block, entry: swept(block, entry)[0], "_id").where("kept_id.parent is not null")
        return scratch.kept(found.select(F.col("kept_id.child").alias(child_id), F.col("kept_id.parent").alias(parent_id)), "contained")
