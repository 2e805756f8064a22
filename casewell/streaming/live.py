"""Stateful aggregates over streams. They use the built-in operators, which combine rows
before the shuffle, so that hot keys cost one row per map task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import latest_per_id, rejected_events, valid_events
from ..operators.filters import originals
from ..operators.sessions import session_bursts


def channel_counts_live(complaints: DataFrame, delay: str = "1 hour", size: str = "1 day"
                        ) -> DataFrame:
    """Complaints per channel and day; append mode emits a day once it is complete."""
    return (
        originals(complaints).where(F.col("channel").isNotNull())
        .withWatermark("created_date", delay)
        .groupBy(F.window("created_date", size).alias("_w"), "channel")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                "channel", "count")
    )


def bursts_live(events: DataFrame, key: str, ts: str, gap: str = "30 minutes",
                delay: str = "1 hour") -> DataFrame:
    """Bursts of a key's events as they close: append mode emits a burst once the watermark has
    passed its last event by the gap. Sessions are merged before the shuffle and in state."""
    return session_bursts(events.withWatermark(ts, delay), key, ts, gap)


def status_counts_live(complaints: DataFrame) -> DataFrame:
    """Figures of a polled dashboard: counts by status and severity (complete or update)."""
    return originals(complaints).groupBy("status", "severity").agg(
        F.count(F.lit(1)).alias("count"))


def latest_live(events: DataFrame) -> DataFrame:
    """Last write per complaint, by sequence and not by arrival. Use update mode with
    `append_batches` at scale: a batch then writes only the complaints it changed."""
    return latest_per_id(events)


def first_escalations(events: DataFrame, ts: str = "escalated_at", delay: str = "1 day"
                      ) -> DataFrame:
    """Drop repeated escalations of a complaint inside the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["complaint_id"])


def valid_live(events: DataFrame, register: DataFrame) -> DataFrame:
    return valid_events(events, register)


def rejected_live(events: DataFrame, register: DataFrame) -> DataFrame:
    """Events about unknown complaints go to a side table; the stream goes on."""
    return rejected_events(events, register)
