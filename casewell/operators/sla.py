"""Deadline (SLA) tracking. Everything is a row-wise expression over (severity, created_date,
override, as_of), so a scan stays one codegen stage; only overrides add a join."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.text import lookup
from ..functions.time import add_hours, as_timestamp, format_minute, hours_between
from .filters import is_unresolved, originals

Clock = Column | str | datetime
REPORT = ["complaint_id", "category", "severity", "status", "branch"]


def sla_status(remaining: Column, hours: Column) -> Column:
    return (
        F.when(remaining < 0, "Breached")
        .when(remaining < hours * F.lit(S.AT_RISK_FRACTION), "At Risk")
        .when(remaining.isNotNull(), "On Track")
    )


def completion_pct(remaining: Column, hours: Column) -> Column:
    """100 once breached; measured against the base hours even after an extension, so a
    long extension or a future creation date gives a negative value."""
    return F.when(remaining < 0, F.lit(100.0)).when(
        remaining.isNotNull(),
        F.least(F.lit(100.0), (F.lit(1.0) - remaining / hours) * F.lit(100.0)),
    )


def sla_columns(
    df: DataFrame,
    as_of: Clock,
    overrides: DataFrame | None = None,
    cfg: Mapping[str, int] = S.SLA_HOURS,
) -> DataFrame:
    """Add sla_hours, due_date, hours_remaining, is_breached, sla_status, completion_pct.

    `overrides` holds one (complaint_id, due_date) per extended complaint. Rows without a
    creation date get null deadline columns."""
    hours = lookup("severity", cfg, S.DEFAULT_SLA_HOURS)
    due = add_hours("created_date", hours)
    if overrides is not None:
        df = df.join(
            overrides.select("complaint_id", F.col("due_date").alias("_override")),
            "complaint_id", "left",
        )
        due = F.coalesce("_override", due)
    df = df.withColumns({"sla_hours": hours, "due_date": due}).withColumn(
        "hours_remaining", hours_between(F.col("due_date"), as_timestamp(as_of))
    )
    remaining, base = F.col("hours_remaining"), F.col("sla_hours")
    return df.withColumns({
        "is_breached": remaining < 0,
        "sla_status": sla_status(remaining, base),
        "completion_pct": completion_pct(remaining, base),
    }).drop("_override")


def sla_display(df: DataFrame) -> DataFrame:
    """Presentation form: minute text and one decimal, half-even."""
    return df.withColumns({
        "due_date": format_minute("due_date"),
        "hours_remaining": F.bround("hours_remaining", 1),
        "completion_pct": F.bround("completion_pct", 1),
    })


def sla_for(df: DataFrame, complaint_id: str, as_of: Clock,
            overrides: DataFrame | None = None) -> DataFrame:
    one = df.where(F.col("complaint_id") == complaint_id)
    if overrides is not None:
        overrides = overrides.where(F.col("complaint_id") == complaint_id)
    return sla_display(sla_columns(one, as_of, overrides)).select(
        "complaint_id", "sla_hours", "due_date", "hours_remaining", "is_breached", "sla_status",
        "completion_pct",
    )


def breached(df: DataFrame, as_of: Clock, overrides: DataFrame | None = None) -> DataFrame:
    """All breached, unresolved originals."""
    return sla_columns(originals(df), as_of, overrides).where(
        F.col("is_breached") & is_unresolved()
    )


def at_risk(df: DataFrame, as_of: Clock, overrides: DataFrame | None = None) -> DataFrame:
    """All unresolved originals in the last fifth of their time."""
    return sla_columns(originals(df), as_of, overrides).where(
        (F.col("sla_status") == "At Risk") & is_unresolved()
    )


#: Tasks that merge the lists of all others, and the last task merges theirs.
MERGE_TASKS = 32


def _least(n: int, total: str):
    """Batches to their first n rows by id, with the number of rows on the first of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            count += pc.sum(table[total]).as_py() or 0
            if kept is not None:
                table = pa.concat_tables([kept, table])
            # not select_k_unstable, which leaves out null ids
            order = pc.sort_indices(table, [("complaint_id", "ascending")], null_placement="at_end")
            kept = table.take(order[:n]).combine_chunks()
        if kept is not None and kept.num_rows:
            totals = pa.array([count] + [0] * (kept.num_rows - 1), pa.int64())
            at = kept.schema.get_field_index(total)
            yield from kept.set_column(at, pa.field(total, pa.int64()), totals).to_batches()
    return run


def capped(df: DataFrame, n: int, total: str = "total") -> DataFrame:
    """First n rows by id beside the uncapped total, from one pass over `df`: each task keeps its
    n least rows and counts the others, and these short lists are merged in two levels, so that
    n rows a task are shuffled and never the table. Select the columns to show before.

    Null ids come last. Rows of equal id are taken in any order. An empty table gives no row,
    as does n = 0. A column named as the total is replaced."""
    if n <= 0:
        return df.withColumn(total, F.lit(0).cast("bigint")).limit(0)
    lists = df.withColumn(total, F.lit(1).cast("bigint"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in lists.schema.fields])
    step = _least(n, total)
    for tasks in (MERGE_TASKS, 1):
        lists = lists.mapInArrow(step, schema).repartition(tasks)
    merged = lists.mapInArrow(step, schema)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(  # n rows at most
        Window.unboundedPreceding, Window.unboundedFollowing)
    return merged.withColumn(total, F.sum(total).over(whole)).orderBy(
        F.asc_nulls_last("complaint_id"))


def sla_summary(df: DataFrame, as_of: Clock, overrides: DataFrame | None = None) -> DataFrame:
    """Counts by state over unresolved originals, and the on-track share (100 when empty)."""
    rows = sla_columns(originals(df).where(is_unresolved()), as_of, overrides)
    counts = rows.agg(
        F.count("sla_status").alias("total_open"),
        F.count_if(F.col("sla_status") == "On Track").alias("on_track"),
        F.count_if(F.col("sla_status") == "At Risk").alias("at_risk"),
        F.count_if(F.col("sla_status") == "Breached").alias("breached"),
    )
    return counts.withColumn("compliance_rate", compliance("on_track", "total_open"))


def compliance(on_track: str, total: str) -> Column:
    ratio = F.try_divide(F.col(on_track).cast("double"), F.col(total).cast("double"))
    return F.coalesce(ratio * F.lit(100.0), F.lit(100.0))


def regulatory_flags(df: DataFrame, as_of: Clock, overrides: DataFrame | None = None) -> DataFrame:
    """Originals that are critical or breached, resolved ones included."""
    rows = sla_columns(originals(df), as_of, overrides)
    critical = F.coalesce(F.col("severity") == "Critical", F.lit(False))
    return (
        rows.where(critical | F.col("is_breached"))
        .withColumn("flag_reason", F.when(critical, "Critical severity").otherwise("SLA breached"))
        .select(*REPORT, F.col("created_date").cast("string").alias("created_date"),
                F.col("is_breached").alias("sla_breached"), "flag_reason")
    )
