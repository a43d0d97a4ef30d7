"""As-of and interval joins whose rows are dealt by key and stretch of time, so that a hot key is many groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(time: str) -> Column:
    """Seconds since 1970 of a zone-free timestamp, as a decimal-free number of microseconds."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, take: list[str], *, seconds: int = 86_400, strict: bool = False) -> DataFrame:
    """left with right's columns `take` and right_time of the last right row at or before (strict: before) each left row's time, of the same key; nulls where there is none.

    Keys match null-safe; a left row without a time gets nulls, a right row without one is left out.  Of right rows of
    one time the greatest by `take` counts.  Rows are dealt by key and stretch of `seconds`: within a stretch a window
    runs over both sides, and what earlier stretches leave behind comes from one row a stretch, so no task holds all of a
    key.  left's rows stay as they are, repeated or not; `by` may be empty.
    """
    own = left.columns
    micros, width = "__t", seconds * 1_000_000
    stretch = lambda df, at: df.withColumn(micros, _seconds(at)).withColumn("__b", F.floor(F.col(micros) / width))
    found = F.struct(F.col(right_time), *take)
    points = stretch(right.where(F.col(right_time).isNotNull()), right_time).select(*by, micros, "__b", found.alias("__found"))
    rows = stretch(left, time).withColumn("__row", F.struct(*own))
    both = rows.select(*by, micros, "__b", F.col("__row"), F.lit(None).cast(points.schema["__found"].dataType).alias("__found"), F.lit(0 if strict else 1).alias("__side"))
    both = both.unionByName(points.select(*by, micros, "__b", F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "__found", F.lit(1 if strict else 0).alias("__side")))
    inside = Window.partitionBy(*by, "__b").orderBy(micros, "__side", "__found").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__near", F.last("__found", ignorenulls=True).over(inside)).where("__row IS NOT NULL").select(*by, "__b", micros, "__row", "__near")
    last = both.groupBy(*by, "__b").agg(F.max(F.when(F.col("__found").isNotNull(), F.struct(micros, "__found"))).alias("__last"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*(F.col(c).alias(f"__k{k}") for k, c in enumerate(by)), F.col("__b").alias("__kb"), F.last("__last.__found", ignorenulls=True).over(before).alias("__carried"))
    on = F.col("__b").eqNullSafe(F.col("__kb"))
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{k}"))
    out = near.join(carried, on, "left")
    # Without a time (null stretch) nothing is at or before a row.
    got = F.when(F.col("__b").isNotNull(), F.coalesce("__near", "__carried"))
    return out.select("__row.*", *(got[c].alias(c) for c in (right_time, *take)))


def in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, begin: str, end: str, *, width: int) -> DataFrame:
    """points joined with the intervals of the same key (columns `by` of both) that hold the point: begin <= at < end, all of them numbers.

    Intervals are dealt to every stretch of `width` that they touch and points to their own, so a pair meets once and a
    hot key is spread over its stretches; choose a width near a usual interval's length.  Rows with null keys, points or
    ends meet nothing, and an empty interval (end <= begin) holds nothing.  A repeated row meets as often as it is there.
    """
    known = intervals.where((F.col(begin) < F.col(end))).withColumn("__b", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("__b", F.floor(F.col(at) / width)).join(known, [*by, "__b"]).where((F.col(begin) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__b")
