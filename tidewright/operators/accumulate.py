"""Sets that grow along a key's states, without joining every state with all that came before it.

Each change counts from one state on, found by one merge of the times of changes and states. Changes go by key and chunk of
`chunk` states; what came before a chunk is one running list over chunks, and a state adds its chunk's changes up to its own.
Rows are states, changes and chunks - never pairs of a state and a change - and a key's states spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_step(times: DataFrame, steps: DataFrame, group: Sequence[str], at: str, out: str) -> DataFrame:
    """(group, at, out): for each time the `out` of the first step of its group at or after it; times after all steps are dropped."""
    rows = times.select(*group, at).distinct().where(F.col(at).isNotNull()).withColumns({"_side": F.lit(1), out: F.lit(None).cast(steps.schema[out].dataType)})
    merged = rows.unionByName(steps.select(*group, at, F.lit(0).alias("_side"), out))
    back = Window.partitionBy(*group).orderBy(F.desc(at), "_side").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn(out, F.last(out, ignorenulls=True).over(back)).where((F.col("_side") == 1) & F.col(out).isNotNull()).drop("_side")


def running_sets(states: DataFrame, changes: DataFrame, group: Sequence[str], key: Sequence[str], at: str, values: Sequence[str], chunk: int = 256) -> DataFrame:
    """Each distinct state (group, key, at) with, for each array column of `values`, the sorted set of what changes of its group and key
    hold whose `at` is its own or earlier. States that nothing precedes get empty arrays; changes without a time never count.
    """
    own = [*group, *key]
    asked = states.select(*own, at).distinct()
    steps = asked.select(*group, at).distinct().withColumn("_step", F.row_number().over(Window.partitionBy(*group).orderBy(at)) - 1)
    counted = first_step(changes, steps, group, at, "_step")
    in_chunk = F.floor(F.col("_step") / chunk).alias("_chunk")
    news = changes.join(counted, [*group, at]).groupBy(*own, in_chunk).agg(F.collect_list(F.struct("_step", *values)).alias("_news"))
    grid = asked.join(steps, [*group, at]).groupBy(*own, in_chunk).agg(F.collect_list(F.struct("_step", F.col(at).alias("at"))).alias("_asked"))
    both = grid.join(news, [*own, "_chunk"], "full_outer")
    before = Window.partitionBy(*own).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    def all_of(changes: Column, v: str) -> Column:
        return F.flatten(F.transform(changes, lambda x: x[v]))

    based = both.withColumns({f"_base_{v}": F.flatten(F.collect_list(all_of(F.col("_news"), v)).over(before)) for v in values})
    each = based.where("_asked is not null").select(*own, F.explode("_asked").alias("_state"), "_news", *[f"_base_{v}" for v in values])
    recent = F.filter(F.col("_news"), lambda x: x["_step"] <= F.col("_state._step"))

    def upto(v: str) -> Column:
        return F.sort_array(F.array_distinct(F.when(F.col("_news").isNull(), F.col(f"_base_{v}")).otherwise(F.concat(f"_base_{v}", all_of(recent, v)))))

    return each.select(*own, F.col("_state.at").alias(at), *[upto(v).alias(v) for v in values])
