"""Filters by position, quotas, top-k, sampling, deduplication and set operations. Every rank has a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.scratch import Scratch, staged

from .joins import first_per

_MOST_TAKEN = 100_000  # rows of an order that one task may number


def slice_rows(df: DataFrame, order: Sequence[str], skip: int = 0, stride: int = 1, limit: int | None = None) -> DataFrame:
    """Rows skip, skip + stride, ... of an order; `limit` of them at most. Filters go before, so positions are of what is left.

    Positions come from ranks within range partitions and the sizes of those before, so no task sees all rows.
    """
    if skip < 0 or stride < 1:
        raise ValueError("skip must be 0 or more and stride 1 or more")
    stop = None if limit is None else skip + stride * limit
    if stop is not None and stop <= _MOST_TAKEN:  # the first rows of the order are enough, and few
        first = df.orderBy(*order).limit(stop)
        numbered = first.withColumn("_pos", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        numbered = with_position(df, order)
    out = numbered.where((F.col("_pos") >= skip) & ((F.col("_pos") - skip) % stride == 0))
    return (out if stop is None else out.where(F.col("_pos") < stop)).drop("_pos")


def povs_of(segments: DataFrame, player: str | None = None, keep: Sequence[str] = ("segment_id",), povs: str = "povs", roster: Sequence[str] | None = None) -> DataFrame:
    """One row a view of each segment, of one player if given; views of others go before anything is exploded.

    A player outside `roster` is refused. Segments of null or no views give no rows.
    """
    if player is not None and roster is not None and player not in roster:
        raise ValueError(f"unknown player {player!r}")
    wanted = F.col(povs) if player is None else F.filter(povs, lambda p: p["player_id"] == player)
    return segments.select(*keep, F.inline(wanted))


def clips_of(clips: DataFrame, order: Sequence[str], game: object = None, player: object = None, limit: int | None = None) -> DataFrame:
    """Clips of a game and a player, where given; the first `limit` of them in order."""
    for column, value in (("game_id", game), ("player_id", player)):
        clips = clips if value is None else clips.where(F.col(column) == value)
    return clips if limit is None else clips.orderBy(*order).limit(limit)


def with_position(df: DataFrame, order: Sequence[str], out: str = "_pos") -> DataFrame:
    """Adds the position of each row in a total order, from 0."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ids count on along a sorted partition: its number above 33 bits, a row's rank in it below; so rows are shuffled once.
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # Bounds of ranges come from a sample, which differs between evaluations: ranks and sizes must see one and the same.
    local = staged(ranged.withColumns({"_part": F.shiftright("_id", 33), "_rank": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "positions")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row a range
    return local.join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + F.col("_rank")).drop("_part", "_rank", "_base")


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Adds each row's number within its key, from 1, in a total order; a hot key is as many tasks as its rows fill."""
    placed = with_position(df, [*key, *order], "_at")
    first = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min("_at").alias("_first"))
    first = staged(first, "firsts")  # its size is known when the join is planned: where it is small the rows aren't shuffled again
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(first, same).withColumn(out, F.col("_at") - F.col("_first") + 1).drop("_at", "_first", *[f"_k{i}" for i, _ in enumerate(key)])


def quota_then_fill(df: DataFrame, stratum: str, strata: Sequence[str], shares: dict[str, float], limit: int, order: Sequence[str], key: Sequence[str]) -> DataFrame:
    """A minimum from each stratum in the strata's order, then the rest in that order, `limit` in all, keys once.

    Each stratum's first max(1, limit * share) rows are looked at before duplicates are removed, so a duplicate there uses
    up quota.
    """
    quotas = {name: max(1, int(limit * shares[name])) for name in strata}
    rank, quota = F.lit(len(strata)), F.lit(0)
    for i, name in enumerate(strata):
        rank = F.when(F.col(stratum) == name, i).otherwise(rank)
        quota = F.when(F.col(stratum) == name, quotas[name]).otherwise(quota)
    rows = df.withColumns({"_r": rank, "_q": quota}).where(F.col("_r") < len(strata))
    # A rank below a constant keeps that many rows of a stratum in each partition before anything is shuffled.
    numbered = rows.withColumn("_seq", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_seq") <= max(quotas.values()))
    head = first_per(numbered.where(F.col("_seq") <= F.col("_q")).drop("_seq"), key, ["_r", *order])
    used = head.select(*[F.col(k).alias(f"_u{i}") for i, k in enumerate(key)])
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_u{i}"))
    left = rows.join(used, same, "left_anti")
    columns = F.struct(*[F.col(c) for c in left.columns])
    once = left.groupBy(*key).agg(F.min_by(columns, F.struct("_r", *order)).alias("_row")).select("_row.*")  # in partial aggregates
    fill = once.orderBy("_r", *order).limit(limit)
    both = head.withColumn("_phase", F.lit(0)).unionByName(fill.withColumn("_phase", F.lit(1)))
    return both.orderBy("_phase", "_r", *order).limit(limit).drop("_r", "_q", "_phase")


def round_robin(df: DataFrame, stratum: str, strata: Sequence[str], score: str, limit: int, order: Sequence[str], each: int | None = None) -> DataFrame:
    """The best of each stratum in turns, k = max(1, min(8, limit // 5)) of each, then the best left; `position` from 0."""
    k = each or max(1, min(8, limit // 5))
    place = F.lit(len(strata))
    for i, name in enumerate(strata):
        place = F.when(F.col(stratum) == name, i).otherwise(place)
    best = [F.desc(score), *[F.col(c) for c in order]]
    number = F.row_number().over(Window.partitionBy(stratum).orderBy(*best))
    first = df.withColumn("_s", place).where(F.col("_s") < len(strata)).withColumn("_n", number).where(F.col("_n") <= k)
    # The best of all rows hold each stratum's best in order, so their numbers among these are their numbers among all.
    top = df.orderBy(*best).limit(limit + k * len(strata)).withColumns({"_s": place, "_n": number})
    rest = top.where((F.col("_n") > k) | (F.col("_s") == len(strata))).orderBy(*best).limit(limit)
    both = first.withColumn("_a", F.lit(0)).unionByName(rest.withColumn("_a", F.lit(1)))
    turn = ["_a", F.when(F.col("_a") == 0, F.col("_n")), F.when(F.col("_a") == 0, F.col("_s")), *best]
    return both.orderBy(*turn).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*turn)) - 1).drop("_s", "_n", "_a")  # `limit` rows


def top_items(values: Column, fields: Sequence[str], n: int) -> Column:
    """The first `n` structs of an array by fields, largest first; ties keep their order."""
    indexed = F.transform(values, lambda v, i: F.struct(*[(-v[f].cast("double")).alias(f"k{j}") for j, f in enumerate(fields)], i.alias("i"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(indexed), 1, n), lambda x: x["v"])


def per_stratum(df: DataFrame, stratum: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first `n` rows of each stratum."""
    return first_per(df, stratum, order, n)


def hash_sample(df: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """`n` rows in the order of a seeded hash of their id: the same rows whatever the partitions."""
    return df.orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), row_id).limit(n)


def shards(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """`shard`: position in a total order divided by the size."""
    return with_position(df, order).withColumn("shard", F.floor(F.col("_pos") / size)).drop("_pos")


def prefer(available: Column, preferred: Column) -> Column:
    """The first preferred item that is available, else the smallest."""
    return F.coalesce(F.get(F.array_intersect(preferred, available), 0), F.array_min(available))


def first_available(df: DataFrame, options: DataFrame, key: str, option: str, rank: str, existing: DataFrame) -> DataFrame:
    """The first of each row's ranked options that exists; rows without one keep null."""
    ok = options.join(existing.select(option).distinct(), option, "left_semi")
    return df.join(ok.groupBy(key).agg(F.min_by(option, rank).alias(option)), key, "left")


def most_frequent(df: DataFrame, name: str) -> DataFrame:
    """The name with the most rows, the smallest on ties."""
    return df.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(1)


def priority_queue(df: DataFrame, rules: Sequence[tuple[Column, str]], order: Sequence[str], n: int = 30) -> DataFrame:
    """The first rule that holds names the next action; the first `n` by rule and order."""
    action, rank = F.lit(None).cast("string"), F.lit(len(rules))
    for i, (when, name) in reversed(list(enumerate(rules))):
        action, rank = F.when(when, name).otherwise(action), F.when(when, i).otherwise(rank)
    return df.withColumns({"next_action": action, "priority": rank}).where("next_action is not null").orderBy("priority", *order).limit(n)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per(df, key, order)


def latest_attempt(df: DataFrame, key: str, status: str, order: str, good: str = "ok") -> DataFrame:
    """The last row of each key, but a good one isn't replaced by a bad one."""
    return first_per(df, [key], [F.desc(F.coalesce(F.col(status) == good, F.lit(False))), F.desc(order)])


def union_passes(passes: Sequence[DataFrame], semantic: Sequence[str], row_id: str, order: Sequence[str]) -> DataFrame:
    """Passes one after another: rows of a known semantic key are skipped, ids that collide are numbered `_2`, `_3`, ..."""
    every = None
    for i, p in enumerate(passes):
        p = p.withColumn("_pass", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    once = first_per(every, semantic, ["_pass", *order])
    return safe_ids(once.withColumn("original_id", F.col(row_id)), row_id, ["_pass", *order]).drop("_pass")


def safe_ids(df: DataFrame, row_id: str, order: Sequence[str], suffix: str | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """`row_id` made unique within `scope`, as by a pass in a total order: an id that is taken gets its row's suffix, then `_2`, `_3`, ...
    after that; without a suffix `_2`, `_3`, ... at once. Names so made are taken for later rows, whether made or given.

    Each row proposes its next name; of those with one name the first in order stands, the others go on to their next. That ends
    where the pass does, since every name prefers the same rows. Rows of equal id and suffix take names in order, so
    they skip ahead by their rank, and rounds are few. Order and scope columns aren't null; a null id stays null.
    """
    at = F.struct(*[F.col(c) for c in order])
    tail = F.col(suffix).cast("string") if suffix else F.lit(None).cast("string")
    rows = df.select(*scope, F.col(row_id).cast("string").alias("_id"), tail.alias("_suffix"), at.alias("_at"))
    ahead = Window.partitionBy(*scope, "_id", "_suffix").orderBy("_at")
    base = F.concat_ws("_", "_id", "_suffix")
    extra = F.col("_try") + F.when(F.col("_suffix").isNull(), 1).otherwise(0)
    name = F.when(F.col("_try") == 0, F.col("_id")).when(extra == 1, base).otherwise(F.concat(base, F.lit("_"), extra.cast("string")))
    with Scratch(df.sparkSession) as scratch:
        tries = scratch.staged(rows.withColumn("_try", F.lit(0).cast("long")), "tries_0")
        for n in range(1, 1 << 30):
            place = F.row_number().over(ahead)
            tries = tries.withColumn("_gap", F.col("_try") - place).withColumn("_try", place + F.max("_gap").over(ahead.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
            named = scratch.staged(tries.withColumn("_name", name), f"names_{n}")
            taken = named.groupBy(*scope, "_name").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
            if taken.isEmpty():
                break
            met = named.join(taken, [*scope, "_name"], "left")
            lost = F.col("_first").isNotNull() & (F.col("_at") != F.col("_first"))
            tries = scratch.staged(met.select(*scope, "_id", "_suffix", "_at", (F.col("_try") + lost.cast("int")).alias("_try")), f"tries_{n}")
        final = scratch.kept(named.select(*scope, "_at", "_name"), "ids")
    return df.withColumn("_at", at).join(final, [*scope, "_at"]).withColumn(row_id, F.col("_name")).drop("_at", "_name").select(df.columns)


def missing_from(df: DataFrame, key: str, values: str, roster: Column) -> DataFrame:
    """Roster members that a key lacks, as a sorted array."""
    return df.groupBy(key).agg(F.collect_set(values).alias("_have")).select(key, F.array_sort(F.array_except(roster, "_have")).alias("missing"))


def index_gaps(df: DataFrame, key: Sequence[str], idx: str) -> DataFrame:
    """Integers from 0 to each key's largest that it lacks."""
    span = df.groupBy(*key).agg(F.max(idx).alias("_top"))
    wanted = span.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top").cast("long"))).alias(idx))
    return wanted.join(df.select(*key, F.col(idx).cast("long").alias(idx)), [*key, idx], "left_anti")


def at_least(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Rows of keys that have `n` rows or more."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where(F.col("_n") >= n).drop("_n")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def options_without_repeats(options: Column, correct: Column) -> Column:
    """struct(options, letter): distinct options in order, and the letter that the correct one has then."""
    once = F.array_distinct(options)
    return F.struct(once.alias("options"), F.char(F.array_position(once, correct) + 64).alias("letter"))
