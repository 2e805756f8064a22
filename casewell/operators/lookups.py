"""Constant lookups. Each dictionary has ten entries at most and is part of the plan as a CASE
expression, so that no lookup adds a join, a shuffle or a broadcast."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import lookup


def with_sla_hours(
    df: DataFrame, cfg: Mapping[str, int] = S.SLA_HOURS, default: int = S.DEFAULT_SLA_HOURS
) -> DataFrame:
    return df.withColumn("sla_hours", lookup("severity", cfg, default))


def with_department(df: DataFrame, column: str = "category", out: str = "department") -> DataFrame:
    return df.withColumn(out, lookup(column, S.DEPARTMENTS, S.DEFAULT_DEPARTMENT))


def with_channel_icon(df: DataFrame) -> DataFrame:
    return df.withColumn("icon", lookup("channel", S.CHANNEL_ICONS, S.DEFAULT_ICON))


def with_priority(df: DataFrame, column: str = "severity") -> DataFrame:
    return df.withColumn("priority_score", lookup(column, S.PRIORITY_SCORES, S.DEFAULT_PRIORITY))


def with_tone(df: DataFrame, column: str = "sentiment") -> DataFrame:
    return df.withColumn("customer_tone_tip", lookup(column, S.TONE_TIPS, S.DEFAULT_TONE))


def channel_config_join(counts: DataFrame) -> DataFrame:
    """Every configured channel with its count as text, "—" where nothing came in.

    `counts` (channel, count) is an aggregate; the six configured names select their rows
    by a case-insensitive match before anything is joined."""
    wanted = [c.lower() for c in S.CHANNEL_ICONS]
    found = (
        counts.where(F.lower("channel").isin(wanted))
        .groupBy(F.lower("channel").alias("_name"))
        .agg(F.max("count").alias("_count"))
    )
    config = counts.sparkSession.createDataFrame(
        [(n, n.lower(), i) for n, i in S.CHANNEL_ICONS.items()],
        "name string, _name string, icon string",
    )
    # at most six rows on the right after the filter and the group-by
    return config.join(F.broadcast(found), "_name", "left").select(
        "name", "icon", F.coalesce(F.col("_count").cast("string"), F.lit("—")).alias("count")
    )
