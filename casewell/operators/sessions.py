"""Bursts of activity: events of a key that follow each other within a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeline import SLICE_HOURS, time_slice


def session_bursts(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """(key, burst_start, burst_end, events) by session windows, for batches and streams. An
    event joins the burst of the one before if it is no farther from it than the gap. Events
    without a time or a key are left out."""
    return (
        events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(key, F.session_window(ts, gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("burst_end"))
        .select(key, F.col("_w.start").alias("burst_start"), "burst_end", "events")
    )


def gap_islands(events: DataFrame, key: str, ts: str, gap_minutes: float = 30,
                slice_hours: float = SLICE_HOURS) -> DataFrame:
    """The same bursts, numbered within their key from 1, by gaps and islands.

    Events are ordered inside (key, slice of time); a slice learns the last event and the number
    of bursts before it from one row per slice, so that a busy key is many tasks."""
    gap = int(gap_minutes * 60_000_000)
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"),
        F.col(ts).alias("_ts"), time_slice(ts, slice_hours).alias("_slice"))
    inside = Window.partitionBy(key, "_slice").orderBy("_t")
    rows = rows.withColumn("_gap", F.col("_t") - F.lag("_t").over(inside))
    new = F.coalesce((F.col("_gap") > gap).cast("long"), F.lit(0))
    slices = rows.groupBy(key, "_slice").agg(
        F.sum(new).alias("_inner"), F.min("_t").alias("_head"), F.max("_t").alias("_tail"))
    order = Window.partitionBy(key).orderBy("_slice")
    slices = slices.withColumn(
        "_opens", F.coalesce((F.col("_head") - F.lag("_tail").over(order) > gap), F.lit(True))
        .cast("long"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.select(key, "_slice", (
        F.sum(F.col("_inner") + F.col("_opens")).over(upto) - F.col("_inner")).alias("_before"))
    growing = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_n", F.sum(new).over(growing))
        .join(slices, [key, "_slice"])
        .groupBy(key, (F.col("_n") + F.col("_before")).alias("burst"))
        .agg(F.min("_ts").alias("burst_start"), F.max("_ts").alias("burst_end"),
             F.count(F.lit(1)).alias("events"))
    )
