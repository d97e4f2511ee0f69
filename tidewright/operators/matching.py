"""Greedy matching and seed clusters in rounds.

What a sequential pass over a total order decides about an item depends only on undecided items near it that come before.
So a round decides all items that come first among those near them at once; the outcome is that of the sequential pass. Items
and edges that are settled leave, so rounds get smaller; each is a few hash joins and minima, and no task holds a group.

Rounds are as many as the longest chain of items that wait for each other: a few in scattered data, more where many lie
close together. Edges come from `joins.range_join`, so their number grows with how many items lie within the tolerance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewright.scratch import Scratch

from .joins import range_join


def greedy_match(edges: DataFrame, left: Sequence[str], right: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The edges that a pass in `order` takes, one at most for each left and each right end. Columns: left, right.

    In each round the edges that are the best of both their ends are taken, and all others of those ends go. Edges that are
    equal in their ends and order count once; null ends match nothing. A round moves the edges left twice, to their right ends and to their left ones.
    """
    ends = list(dict.fromkeys([*left, *right]))
    named = edges.select(*[F.col(c).alias(f"e{i}") for i, c in enumerate(ends)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    total = [*[f"o{i}" for i, _ in enumerate(order)], *[f"e{i}" for i, _ in enumerate(ends)]]
    by_left, by_right = (Window.partitionBy(*[f"e{ends.index(c)}" for c in side]).orderBy(*total) for side in (left, right))
    every = (Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.rank().over(by_left) == 1  # equal edges are all first
    for i, _ in enumerate(ends):
        named = named.where(F.col(f"e{i}").isNotNull())
    with Scratch(edges.sparkSession) as scratch:
        found = scratch.staged(named.withColumns({"best": best, "taken": F.lit(False)}), "edges_0")
        matched = []
        for n in range(1, 1 << 30):
            left_over = found.where("not taken")
            if left_over.isEmpty():
                break
            met = left_over.withColumn("taken", F.col("best") & (F.rank().over(by_right) == 1)).withColumn("gone", F.max("taken").over(by_right.rowsBetween(*every)))
            met = met.withColumn("gone", F.col("gone") | F.max("taken").over(by_left.rowsBetween(*every))).where("taken or not gone")
            # Taken edges stay for the result; as no other edge of their ends does, they don't stand before one.
            found = scratch.staged(met.drop("gone").withColumn("best", best), f"edges_{n}")
            matched.append(found.where("taken"))
        taken = named.limit(0)
        for part in matched:
            taken = taken.unionByName(part.drop("best", "taken"))
        return scratch.kept(taken.select(*[F.col(f"e{i}").alias(c) for i, c in enumerate(ends)]).distinct(), "matched")


def seed_clusters(items: DataFrame, item: Sequence[str], edges: DataFrame, least: int = 2) -> DataFrame:
    """(item, seed columns `seed_*`): in order of `item`, each item not yet in a cluster takes all neighbours that aren't, if with
    itself they are `least` or more.

    edges: `item` and, as `_<name>`, that of a neighbour, both ways. An item is decided once no undecided one before it lies
    within two steps: then none can take it or a neighbour of its any more. What an item's neighbours know of theirs comes in windows over either end of
    the links, which hold both ways: a round moves the links left three times.
    """
    name, there = F.struct(*[F.col(c) for c in item]), F.struct(*[F.col(f"_{c}").alias(c) for c in item])
    of_a, of_b = Window.partitionBy("a"), Window.partitionBy("b")
    untried = lambda end: F.when(~F.col(f"tried_{end}"), F.col(end))

    def seeds(end: str, near: str, of: WindowSpec) -> dict[str, Column]:
        first = F.coalesce(F.min(near).over(of) == F.col(end), F.lit(False)) & ~F.col(f"tried_{end}")
        return {f"first_{end}": first, f"seed_{end}": first & (F.count("*").over(of) + 1 >= least)}

    with Scratch(items.sparkSession) as scratch:
        links = edges.select(name.alias("a"), there.alias("b")).distinct().withColumns({"tried_a": F.lit(False), "tried_b": F.lit(False), "seed": F.lit(None).cast(items.select(name.alias("v")).schema["v"].dataType)})
        links = scratch.staged(links.withColumn("near", F.least("a", F.min("b").over(of_a))), "links_0")
        found = links.limit(0).select(F.col("a").alias("v"), "seed")
        for n in range(1, 1 << 30):
            free = links.where("seed is null")
            if free.where("not tried_a").isEmpty():
                break
            # The least undecided item within one step of an end, then two.
            met = free.withColumns({**seeds("b", "near", of_b), "near_b": F.least(untried("b"), F.min(untried("a")).over(of_b))})
            met = met.withColumns({**seeds("a", "near_b", of_a), "of_a": F.max(F.when(F.col("seed_b"), F.col("b"))).over(of_a), "least_b": F.min("b").over(of_a)})
            taken_b = F.col("seed_b") | F.max("seed_a").over(of_b)
            stays = ~F.col("seed_a") & F.col("of_a").isNull() & ~F.col("taken_b")
            # One row tells of each item that a cluster takes: its link to the seed, a seed's to its least neighbour.
            seed = F.when(F.col("seed_a") & (F.col("b") == F.col("least_b")), F.col("a")).when(F.col("seed_b"), F.col("b"))
            met = met.withColumn("taken_b", taken_b).withColumns({"stays": stays, "seed": seed, "tried_a": F.col("tried_a") | F.col("first_a"), "tried_b": F.col("tried_b") | F.col("first_b")})
            near = F.least(untried("b"), F.min(F.when(F.col("stays"), untried("a"))).over(of_b))
            # Ends change places, so that what an end knows by now is known where its links lie.
            turned = met.withColumn("near", near).where("stays or seed is not null").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("tried_b").alias("tried_a"), F.col("tried_a").alias("tried_b"), "seed", "near")
            links = scratch.staged(turned, f"links_{n}")
            found = found.unionByName(links.where("seed is not null").select(F.col("b").alias("v"), "seed"))
        if least <= 1:  # what has no neighbours left is a cluster of its own
            alone = items.select(name.alias("v")).distinct().join(scratch.staged(found, "found"), "v", "left_anti")
            found = found.unionByName(alone.select("v", F.col("v").alias("seed")))
        return scratch.kept(found.select("v.*", *[F.col(f"seed.{c}").alias(f"seed_{c}") for c in item]), "clusters")


def match_to_anchor(clips: DataFrame, anchor: DataFrame, player: str, label: str, duration: str, idx: str, tolerance: float = 15.0, on: Sequence[str] = ()) -> DataFrame:
    """Greedy one-to-one matching of each player's clips to the anchor's: (on, player, idx, anchor_idx).

    Pairs have equal labels and `on` columns and durations within the tolerance; the closest in duration, then in order, go first.
    """
    a = anchor.select(*on, label, F.col(duration).cast("double").alias("_ad"), F.col(idx).alias("anchor_idx"))
    c = clips.select(*on, player, label, idx, F.col(duration).cast("double").alias("_cd"))
    pairs = range_join(c, a, ("_cd", "_cd"), ("_ad", "_ad"), 2 * tolerance or 1.0, [*on, label], tolerance, tolerance)
    pairs = pairs.withColumns({"_dd": F.abs(F.col("_cd") - F.col("_ad")), "_do": F.abs(F.col(idx) - F.col("anchor_idx"))}).where(F.col("_dd") <= tolerance)
    return greedy_match(pairs, [*on, player, idx], [*on, player, "anchor_idx"], ["_dd", "_do", idx, "anchor_idx"]).select(*on, player, idx, "anchor_idx")


def cluster_leftovers(clips: DataFrame, player: str, label: str, duration: str, idx: str, tolerance: float = 15.0, least: int = 2, on: Sequence[str] = ()) -> DataFrame:
    """Seed clusters of unmatched clips: (on, label, player, idx, seed_player, seed_idx).

    In order of player and index, a clip that is in no cluster takes all others of its label and `on` columns that aren't,
    come from other players and are close in duration.
    """
    item = [*on, label, player, idx]
    c = clips.select(*item, F.col(duration).cast("double").alias("d"))
    other = c.select(*on, label, F.col(player).alias(f"_{player}"), F.col(idx).alias(f"_{idx}"), F.col("d").alias("_d"))
    met = range_join(c, other, ("d", "d"), ("_d", "_d"), 2 * tolerance or 1.0, [*on, label], tolerance, tolerance).where((F.col(player) != F.col(f"_{player}")) & (F.abs(F.col("d") - F.col("_d")) <= tolerance))
    edges = met.withColumns({f"_{c}": F.col(c) for c in [*on, label]})
    return seed_clusters(clips, item, edges, least).drop(*[f"seed_{c}" for c in [*on, label]])
