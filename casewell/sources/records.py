"""Record-shaped outputs: JSON rows, reports, drafts and duplicate pairs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import as_timestamp


def to_records(df: DataFrame, column: str = "record") -> DataFrame:
    """One JSON object per row; null fields are kept so that every record has all keys."""
    return df.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column)
    )


def export_regulatory(rows: DataFrame, path: str, as_of: Column | str | datetime) -> None:
    """The whole report as JSON rows with its export date; no preview cap on the file."""
    rows.withColumn("export_date", F.date_format(as_timestamp(as_of), "yyyy-MM-dd")).write.mode(
        "overwrite"
    ).json(path)


def write_drafts(drafts: DataFrame, path: str) -> None:
    drafts.write.mode("overwrite").json(path)


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = pairs.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
