"""Ordered passes over logs: the next row of a key, and the first row of another log after a time.

A key may hold a third of a log, so no pass runs over a whole key: rows are ordered inside (key,
slice of time), and a slice hands its first row to the slices before it. Per key only one row for
each slice is ordered as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a slice; busier logs take narrower ones.
SLICE_HOURS = 24


def time_slice(ts: Column | str, hours: float = SLICE_HOURS) -> Column:
    """Number of the slice that a time falls into."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros = F.unix_micros(ts.cast("timestamp"))
    width = F.lit(int(hours * 3_600_000_000))
    return ((micros - F.pmod(micros, width)) / width).cast("bigint")


def valid_until(log: DataFrame, ts: str, tie: str, key: str = "complaint_id",
                out: str = "valid_until", slice_hours: float = SLICE_HOURS) -> DataFrame:
    """Each row with the time of the next row of its key by (`ts`, `tie`), null for the last one:
    a log of changes becomes intervals of validity. Rows without a key or time are left out."""
    sliced = log.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(
        "_slice", time_slice(ts, slice_hours))
    inside = Window.partitionBy(key, "_slice").orderBy(ts, tie)
    heads = sliced.groupBy(key, "_slice").agg(F.min(ts).alias("_head"))
    following = Window.partitionBy(key).orderBy("_slice")
    heads = heads.select(key, "_slice", F.lead("_head").over(following).alias("_next"))
    return (
        sliced.withColumn(out, F.lead(ts).over(inside))
        .join(heads, [key, "_slice"])
        .withColumn(out, F.coalesce(out, "_next"))
        .drop("_slice", "_next")
    )


def next_after(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str,
               key: str = "complaint_id", out: str = "next_at",
               slice_hours: float = SLICE_HOURS) -> DataFrame:
    """Rows of `left` with the time of the first row of `right` of the same key at or after their
    own time (null where there is none). Both logs are put together and passed once from the
    latest time to the earliest."""
    known = F.col(key).isNotNull() & F.col(left_ts).isNotNull()
    columns, none = left.columns, F.lit(None).cast("timestamp")
    both = left.where(known).withColumns({
        "_key": F.col(key), "_at": F.col(left_ts).cast("timestamp"), "_hit": none,
        "_left": F.lit(True),
    }).unionByName(
        right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(
            F.col(key).alias("_key"), F.col(right_ts).cast("timestamp").alias("_at"),
            F.col(right_ts).cast("timestamp").alias("_hit"), F.lit(False).alias("_left")),
        allowMissingColumns=True)
    sliced = both.withColumn("_slice", time_slice("_at", slice_hours))
    # backwards in time; at equal times the rows of `right` come first and so count
    inside = Window.partitionBy("_key", "_slice").orderBy(F.desc("_at"), "_left").rowsBetween(
        Window.unboundedPreceding, 0)
    heads = sliced.groupBy("_key", "_slice").agg(F.min("_hit").alias("_head"))
    later = Window.partitionBy("_key").orderBy(F.desc("_slice")).rowsBetween(
        Window.unboundedPreceding, -1)
    heads = heads.select("_key", "_slice", F.min("_head").over(later).alias("_later"))
    matched = (
        sliced.withColumn("_in", F.min("_hit").over(inside)).where("_left")
        .join(heads, ["_key", "_slice"])
        .select(*columns, F.coalesce("_in", "_later").alias(out))
    )
    return matched.unionAll(left.where(~known).select(*columns, none.alias(out)))
