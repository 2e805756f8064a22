"""Dashboard and regulatory aggregates. Each is one partial/final hash aggregation; windows
run only over rows that are already aggregated and capped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import BRANCH_BANDS, RESOLUTION_BANDS, band, ordinal
from ..functions.time import month_of
from .events import with_escalation
from .filters import blank_nulls, is_original, is_unresolved, originals
from .lookups import with_channel_icon
from .sla import Clock, compliance, format_minute, sla_columns

FILTER_COLUMNS = ["category", "sentiment", "severity", "status", "branch", "channel"]


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Originals per key; null keys are dropped."""
    rows = originals(df)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def by_count(df: DataFrame, *keys: str) -> DataFrame:
    """Largest first, the keys as tiebreak."""
    return df.orderBy(F.desc("count"), *keys)


def top_branches(df: DataFrame, n: int = 10) -> DataFrame:
    return by_count(count_by(df, "branch"), "branch").limit(n)


def count_by_channel(df: DataFrame) -> DataFrame:
    return by_count(with_channel_icon(count_by(df, "channel")), "channel")


def monthly_trend(df: DataFrame) -> DataFrame:
    return count_by(df.withColumn("month", month_of("created_date")), "month").orderBy("month")


def heatmap(df: DataFrame) -> DataFrame:
    return count_by(df, "category", "branch")


def category_grid(df: DataFrame, keys: Sequence[str] = ("category", "sentiment", "severity")
                  ) -> DataFrame:
    """All combinations of the values found, with their counts, zero where none occur. The
    grid grows from one row of distinct-value sets by explode; the sets are label domains."""
    counts = count_by(df, *keys)
    grid = counts.agg(*[F.collect_set(k).alias(k) for k in keys])
    for k in keys:
        grid = grid.withColumn(k, F.explode(k))
    return grid.join(counts, list(keys), "left").fillna(0, ["count"])


def branch_rank(df: DataFrame, n: int = 10) -> DataFrame:
    """Top branches with position, badge, share of the largest and its band."""
    top = top_branches(df, n)
    all_rows = Window.partitionBy(F.lit(1))  # n rows at most
    ranked = top.withColumn(
        "rank", F.row_number().over(all_rows.orderBy(F.desc("count"), "branch"))
    ).withColumn("ratio", F.col("count") / F.max("count").over(all_rows))
    return ranked.withColumn("badge", ordinal("rank")).withColumn(
        "band", band("ratio", BRANCH_BANDS, strict=True)
    )


def channel_share(df: DataFrame) -> DataFrame:
    """Percent of all originals per channel, rounded half up."""
    total = originals(df).agg(F.count(F.lit(1))).scalar()
    share = F.col("count") * F.lit(100.0) / F.greatest(total, F.lit(1))
    return count_by(df, "channel").withColumn(
        "percent", F.floor(share + F.lit(0.5)).cast("bigint")
    )


def overview(
    df: DataFrame, as_of: Clock, escalations: DataFrame, overrides: DataFrame | None = None
) -> DataFrame:
    """Thirteen indicators in one pass. Duplicates and average resolution days are taken over
    all rows, everything else over originals."""
    def n(cond: Column) -> Column:
        return F.count_if(is_original() & cond)

    status, sla = F.col("status"), F.col("sla_status")
    sums = sla_columns(df, as_of, overrides).agg(
        F.count_if(is_original()).alias("total_complaints"),
        n(status == "Open").alias("open"),
        n(status == "In Progress").alias("in_progress"),
        n(status == "Resolved").alias("resolved"),
        n(status == "Escalated").alias("escalated"),
        n(F.col("severity") == "Critical").alias("critical_count"),
        n(F.col("severity") == "High").alias("high_count"),
        F.count_if("is_duplicate").alias("duplicate_count"),
        F.avg("resolution_days").alias("avg_resolution_days"),
        n(is_unresolved() & (sla == "Breached")).alias("sla_breached"),
        n(is_unresolved() & (sla == "At Risk")).alias("sla_at_risk"),
        n(is_unresolved() & (sla == "On Track")).alias("_on_track"),
        n(is_unresolved() & sla.isNotNull()).alias("_total"),
    )
    active = escalations.agg(F.count(F.lit(1))).scalar()
    return sums.select(
        *[c for c in sums.columns if not c.startswith("_")],
        compliance("_on_track", "_total").alias("sla_compliance_rate"),
        active.alias("active_escalations"),
    )


def _rate(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part) * F.lit(100.0), F.col(whole).cast("double"))


def category_report(df: DataFrame) -> DataFrame:
    """Per category: totals, outcome counts, resolution rate and its colour band."""
    rows = originals(df).where(F.col("category").isNotNull())
    report = rows.groupBy("category").agg(
        F.count("complaint_id").alias("total"),
        F.count_if(F.col("status") == "Resolved").alias("resolved"),
        F.count_if(F.col("status") == "Escalated").alias("escalated"),
        F.count_if(F.col("severity") == "Critical").alias("critical"),
    )
    return report.withColumn("resolution_rate", _rate("resolved", "total")).withColumn(
        "band", band("resolution_rate", RESOLUTION_BANDS)
    )


def regulatory_summary(df: DataFrame) -> DataFrame:
    """Totals and the category, channel and branch breakdowns from one scan, in long form:
    (dimension, key, total, resolved, pending, escalated, critical, resolution_rate)."""
    dims = ["category", "channel", "branch"]
    rows = originals(df).groupingSets(
        [[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims]
    ).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "Resolved").alias("resolved"),
        F.count_if(is_unresolved()).alias("pending"),
        F.count_if(F.col("status") == "Escalated").alias("escalated"),
        F.count_if(F.col("severity") == "Critical").alias("critical"),
    )
    # bit set = column rolled up; first column is the highest bit
    dimension = (
        F.when(F.col("_gid") == 0b011, "category").when(F.col("_gid") == 0b101, "channel")
        .when(F.col("_gid") == 0b110, "branch").otherwise("total")
    )
    return (
        rows.withColumn("dimension", dimension)
        .withColumn("key", F.coalesce(*dims))
        .where((F.col("dimension") == "total") | F.col("key").isNotNull())
        .withColumn("resolution_rate", _rate("resolved", "total"))
        .select("dimension", "key", "total", "resolved", "pending", "escalated", "critical",
                "resolution_rate")
    )


def escalation_summary(df: DataFrame, escalations: DataFrame) -> DataFrame:
    """Escalations by level, with the total and its rate against the originals."""
    total = escalations.agg(F.count(F.lit(1))).scalar()
    base = originals(df).agg(F.count(F.lit(1))).scalar()
    return (
        escalations.groupBy(F.coalesce("escalation_level", F.lit("Unknown")).alias("level"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("total_escalated", total)
        .withColumn("escalation_rate",
                    total * F.lit(100.0) / F.greatest(base, F.lit(1)))
    )


def filter_options(df: DataFrame, columns: Sequence[str] = tuple(FILTER_COLUMNS)) -> DataFrame:
    """Distinct values per filter column as sorted rows (column, value). Row pairs are
    reduced to distinct ones before the shuffle, so a wide domain stays distributed."""
    rows = originals(df).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns
    ])).alias("_p")).select("_p.column", "_p.value")
    return rows.where(F.col("value").isNotNull()).distinct().orderBy("column", "value")


def _counts_json(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if n is not None:
        counts = counts.orderBy(F.desc("n"), key).limit(n)
    entry = F.struct((-F.col("n")).alias("o"), F.col(key).alias("k"))
    ordered = F.array_sort(F.collect_list(entry))
    pairs = F.transform(ordered, lambda e: F.struct(e["k"].alias("key"), (-e["o"]).alias("value")))
    return counts.agg(F.to_json(F.map_from_entries(pairs)).alias("counts"))


def label_count_maps(df: DataFrame, top: int = 5) -> DataFrame:
    """Value counts of the labels as JSON objects, largest first; branches only the top."""
    rows = originals(df)
    parts = [
        _counts_json(rows, key, n).select(F.lit(name).alias("label"), "counts")
        for name, key, n in [("category", "category", None), ("sentiment", "sentiment", None),
                             ("severity", "severity", None), ("top_branches", "branch", top)]
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def arg_max_label(df: DataFrame, key: str) -> DataFrame:
    """The most frequent value; ties go to the first in order."""
    return by_count(count_by(df, key), key).limit(1).select(key, "count")


def dataset_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_original()).alias("originals"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_distinct("category").alias("categories"),
        F.min("created_date").cast("string").alias("first_date"),
        F.max("created_date").cast("string").alias("last_date"),
    )


def regulatory_export(
    df: DataFrame, as_of: Clock, escalations: DataFrame, overrides: DataFrame | None = None
) -> DataFrame:
    """All originals with deadline and escalation, every field as text, flags as booleans."""
    rows = with_escalation(sla_columns(originals(df), as_of, overrides), escalations)
    rows = rows.select(
        *df.columns, "sla_status", format_minute("due_date").alias("sla_due_date"),
        F.col("is_breached").alias("sla_breached"), "escalated", "escalation_level",
    )
    return blank_nulls(rows, keep=["sla_breached", "escalated"])


def null_safe_overview(df: DataFrame) -> DataFrame:
    """Dashboard defaults for missing fields: 0, and 100 for the compliance rate."""
    return df.select([
        F.coalesce(F.col(c), F.lit(100.0 if c == "sla_compliance_rate" else 0)).alias(c)
        for c in df.columns
    ])


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in random, repeatable order."""
    return df.orderBy(F.rand(seed))


