"""Counters and roll-ups over categories, stages and languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(value: Column) -> Column:
    """A category's name; null and blank are "unknown"."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("unknown"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(named(F.col(column)).alias(column)).agg(F.count("*").alias("n"))


def counters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of several columns in one pass: (field, value, n)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), named(F.col(c)).alias("value")) for c in columns]))
    return df.select(each.alias("_x")).groupBy("_x.field", "_x.value").agg(F.count("*").alias("n"))


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def player_states(events: DataFrame, key: Sequence[str], end: str, description: str, confidence: str) -> DataFrame:
    """Of each key: the latest end, descriptions in order of end, the mean confidence capped at 1."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(end, description))), lambda x: x[description])
    return events.groupBy(*key).agg(F.max(end).alias("cutoff_time"), listed.alias("known_facts"), F.least(F.lit(1.0), F.avg(confidence)).alias("confidence"))


def stage_completeness(outputs: DataFrame, segment: str, stage: str, stages: Sequence[str], needed: dict[str, int]) -> DataFrame:
    """Rows of each segment by stage, whether each has as many as it needs, and the first stage that lacks some."""
    wide = outputs.groupBy(segment).pivot(stage, list(stages)).agg(F.count(F.lit(1))).na.fill(0)
    done = {s: F.col(s) >= needed.get(s, 1) for s in stages}
    action = F.lit("complete")
    for s in reversed(stages):
        action = F.when(~done[s], s).otherwise(action)
    return wide.withColumns({f"{s}_done": d for s, d in done.items()}).withColumn("next_action", action)


def by_language(df: DataFrame, language: Column, correct: str, second: str) -> DataFrame:
    """Accuracy of the first question, and the mean of the second where the first is right."""
    return df.groupBy(language.alias("language")).agg(F.count("*").alias("n"), F.count_if(correct).alias("n_correct"), F.avg(F.when(F.col(correct), F.col(second))).alias("second_mean"))


def first_where(df: DataFrame, key: Sequence[str], order: str, keep: Column, value: str) -> DataFrame:
    """The first value of each key whose row meets a condition."""
    return df.groupBy(*key).agg(F.min_by(F.when(keep, F.col(value)), F.when(keep, F.col(order))).alias(value))


def summed(reports: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Reports added up."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.groupBy(key).agg(F.sum(value).alias(value))


def segment_assembly(clips: DataFrame, key: Sequence[str], member: str, fields: Sequence[str]) -> DataFrame:
    """Clips of equal window gathered into segments, members sorted by name (as many as a roster has)."""
    return clips.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(member, *fields))).alias("members"), F.count("*").alias("member_count"))


def least_squares(df: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    """y = scale * x + offset of each key: n, scale, offset, the median residual and the one at index 0.95 * n.

    Rows meet their key's fit again for the residuals, which are ranked in a sorted stream, not gathered.
    """
    fit = df.groupBy(*key).agg(F.regr_slope(y, x).alias("scale"), F.regr_intercept(y, x).alias("offset"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))
    left = df.select(*key, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(fit, list(key))
    left = left.withColumn("_r", F.abs(F.col(y) - (F.col("scale") * F.col(x) + F.col("offset"))))
    left = left.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy("_r")) - 1)
    middle = (F.col("_i") == F.floor((F.col("n") - 1) / 2)) | (F.col("_i") == F.floor(F.col("n") / 2))
    late = F.col("_i") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return left.groupBy(*key, "n", "scale", "offset").agg(F.avg(F.when(middle, F.col("_r"))).alias("median_residual"), F.max(F.when(late, F.col("_r"))).alias("p95_residual"))
