"""Time and number scalars. Times are DOUBLE seconds on a session clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def certainty(value: Column) -> Column:
    """A number clamped to 0..1, a word's value, else 0.5."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    number = text.try_cast("double")
    return (
        F.when(number.isNotNull(), clamp(number))
        .when(text == "true", 1.0).when(text == "false", 0.0)
        .when(text.isin("high", "高", "很高"), 0.85)
        .when(text.isin("medium", "中", "中等"), 0.6)
        .when(text.isin("low", "低"), 0.35)
        .otherwise(0.5)
    )


def clamp_or(value: Column, default: float) -> Column:
    return clamp(F.coalesce(value.try_cast("double"), F.lit(default)))


def interval_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over the hull of both intervals; 0 where the hull is empty."""
    inter = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, inter / hull).otherwise(0.0)


def interval_distance(start: Column, end: Column, at: Column) -> Column:
    return F.greatest(start - at, at - end, F.lit(0.0))


def nearest_bucket(text: Column, buckets=(0, 25, 50, 75, 100)) -> Column:
    """The first number in a text, clamped, to the nearest bucket; the lower one on ties; 0 without a number."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    v = clamp(F.coalesce(number, F.lit(0.0)), min(buckets), max(buckets))
    return F.array_min(F.transform(F.array(*[F.lit(b) for b in buckets]), lambda b: F.struct(F.abs(b - v).alias("d"), b.alias("b"))))["b"]


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "0.00%").otherwise(F.format_string("%.2f%%", part.cast("double") / whole * 100))


def parse_bool(value: Column, default: bool = False) -> Column:
    t = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off"), False).otherwise(default)


def exact_mean(value: Column, digits: int = 6) -> Column:
    """Aggregate: the mean of values rounded to `digits`, itself rounded half up to as many; null of no rows.

    Summed in integers, so neither the order of rows nor the rounding of a double decides a half.
    """
    units = F.round(value * 10**digits).cast("long")
    twice, n = 2 * F.sum(units) + F.count(units), 2 * F.count(units)
    return F.when(n > 0, F.call_function("div", twice - F.pmod(twice, n), n) / float(10**digits))


def to_absolute(segment_start: Column, local: Column) -> Column:
    return segment_start + local


def model_window(start: Column, end: Column, seg_start: Column, seg_end: Column, least: float = 1.0) -> Column:
    """struct(local_start, local_end): absolute times become local ones, an empty window lasts `least`, inside the segment."""
    duration = seg_end - seg_start
    absolute = (start >= seg_start) & (end <= seg_end + 1e-6) & ((start > duration) | (end > duration))
    s, e = F.when(absolute, start - seg_start).otherwise(start), F.when(absolute, end - seg_start).otherwise(end)
    return F.struct(s.alias("local_start"), F.when(e <= s, F.least(duration, s + least)).otherwise(e).alias("local_end"))


def local_window_ok(local_start: Column, local_end: Column, duration: Column) -> Column:
    return (local_start >= 0) & (local_end > local_start) & (local_end <= duration + 1e-6)


def clip_window(start: Column, end: Column, clip_start: Column, clip_end: Column, least: float = 1.0) -> Column:
    """struct(start_sec, end_sec) inside the clip, at least `least` long; the whole clip where it misses the clip."""
    s, e = F.greatest(clip_start, start), F.least(clip_end, end)
    longer = F.least(clip_end, F.greatest(e, s + least))
    inside = s < clip_end
    return F.struct(F.when(inside, F.greatest(clip_start, F.least(s, longer - least))).otherwise(clip_start).alias("start_sec"), F.when(inside, longer).otherwise(clip_end).alias("end_sec"))


def raw_interval(scale: Column, offset: Column, start: Column, end: Column, duration: Column) -> Column:
    """struct(raw_start, raw_end, ok): the affine map of an interval into the source's clock."""
    s, e = scale * start + offset, scale * end + offset
    return F.struct(s.alias("raw_start"), e.alias("raw_end"), ((s >= 0) & (e > s) & (e <= duration + 1e-6)).alias("ok"))


def context_window(first: Column, last: Column, before: float, after: float, longest: float) -> Column:
    """struct(start_sec, end_sec): events with context; a window that is too long keeps its tail."""
    s, e = F.greatest(F.lit(0.0), first - before), last + after
    return F.struct(F.greatest(s, e - longest).alias("start_sec"), e.alias("end_sec"))


def protocol_seconds(stamp: Column) -> Column:
    """Seconds of a time stamp: digits; MM:SS; of three fields the middle one counts as seconds, as the protocol has it."""
    t = F.trim(F.coalesce(stamp.cast("string"), F.lit("")))
    parts = F.split(t, ":")
    two = F.get(parts, 0).try_cast("int") * 60 + F.get(parts, 1).try_cast("double")
    return F.coalesce(
        F.when(F.size(parts) == 3, F.get(parts, 1).try_cast("double")).when(F.size(parts) == 2, two),
        t.try_cast("double"), F.lit(0.0),
    )


def clock_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)))


def repair_timed_events(df: DataFrame, local_start: str, local_end: str, phase_start: str, phase_end: str, eps: float = 0.05) -> DataFrame:
    """Adds ok, reason, abs_start, abs_end, clipped: an event's times repaired against its phase.

    Times may be local or absolute; swapped ends are put right, points last a second, what leaves the phase is clipped and
    what then lasts less than a tenth of a second is refused. Steps are columns of their own, so each is computed once.
    """
    ls, le, ps, pe = (F.col(c) for c in (local_start, local_end, phase_start, phase_end))
    duration = pe - ps
    inside = lambda x, lo, hi: (x >= lo - eps) & (x <= hi + eps)
    out = df.withColumns({"_local": inside(ls, F.lit(0.0), duration) & inside(le, F.lit(0.0), duration), "_abs": (inside(ls, ps, pe) & inside(le, ps, pe)) | (ls > duration + eps) | (le > duration + eps)})
    out = out.withColumns({"_s": F.when(F.col("_local"), ps + ls).otherwise(ls), "_e": F.when(F.col("_local"), ps + le).otherwise(le)})
    out = out.withColumns({"_lo": F.least("_s", "_e"), "_hi": F.greatest("_s", "_e")})
    out = out.withColumn("_point", (F.col("_hi") - F.col("_lo") < 0.1) & inside(F.col("_lo"), ps, pe))
    out = out.withColumn("_hi", F.when(F.col("_point"), F.least(pe, F.col("_lo") + 1.0)).otherwise(F.col("_hi")))
    out = out.withColumn("_lo", F.when(F.col("_point") & (F.col("_hi") - F.col("_lo") < 0.1), F.greatest(ps, F.col("_hi") - 1.0)).otherwise(F.col("_lo")))
    out = out.withColumns({"_cs": F.greatest(ps, F.col("_lo")), "_ce": F.least(pe, F.col("_hi"))})
    moved = (F.col("_cs") != F.col("_lo")) | (F.col("_ce") != F.col("_hi"))
    reason = (
        F.when(ls.isNull() | le.isNull(), "missing_time").when(~(F.col("_local") | F.col("_abs")), "unrecognized_time").when(F.col("_ce") - F.col("_cs") < 0.1, "outside_phase_time")
        .when(moved, "clipped_to_phase").when(F.col("_point"), "expanded_point_time").when(F.col("_e") < F.col("_s"), "swapped_time_order")
        .when(F.col("_local"), "already_local").otherwise("converted_abs_to_local")
    )
    out = out.withColumn("reason", reason).withColumn("ok", ~F.col("reason").isin("missing_time", "unrecognized_time", "outside_phase_time"))
    r = lambda c: F.when(F.col("ok"), F.round(c, 3))
    out = out.withColumns({"abs_start": r("_cs"), "abs_end": r("_ce"), "clipped": F.col("reason") == "clipped_to_phase"})
    return out.drop("_local", "_abs", "_s", "_e", "_lo", "_hi", "_point", "_cs", "_ce")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, in the order of their places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)
