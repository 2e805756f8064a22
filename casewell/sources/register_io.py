"""Register files: CSV as the applications exchange it, Parquet by month for the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.time import month_of, parse_created
from .split_csv import read_split_csv


def _text_date(schema: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.name == "created_date" else f.dataType)
        for f in schema.fields
    ])


def read_register(
    spark: SparkSession, path: str, classified: bool = True, multi_line: bool = True
) -> DataFrame:
    """CSV with header and a fixed schema (no inference pass); empty fields become null.

    Quoted texts may hold line breaks, so `multi_line` is on and each file is one task: at
    scale ingest many files, or switch it off for single-line texts so files are split."""
    schema = S.REGISTER_SCHEMA if classified else S.BASE_SCHEMA
    raw = (
        spark.read.schema(_text_date(schema))
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return raw.withColumn("created_date", parse_created("created_date"))


def read_register_split(spark: SparkSession, path: str,
                        classified: bool = True) -> tuple[DataFrame, DataFrame]:
    """(register, rejected records) of CSV files of any size, each read by many tasks although
    texts hold line breaks. Rejected are (file, at, no, text), see `split_csv`."""
    schema = S.REGISTER_SCHEMA if classified else S.BASE_SCHEMA
    rows, broken = read_split_csv(spark, path, _text_date(schema))
    return rows.withColumn("created_date", parse_created("created_date")), broken


def read_register_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Month-partitioned register; a filter on `month` prunes directories."""
    return spark.read.parquet(path)


def write_register(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet partitioned by month (CSV without partitions for exchange).

    Rows are gathered by month with a rebalance hint: small months share a task, and a busy
    month is split by size, so that no month becomes a single writer. Rows are sorted by id
    inside a task, so that a lookup by id skips row groups."""
    if fmt == "csv":
        (
            df.withColumn("created_date", F.date_format("created_date", "yyyy-MM-dd HH:mm:ss"))
            .write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        )
        return
    (
        df.withColumn("month", month_of("created_date"))
        .hint("rebalance", "month").sortWithinPartitions("month", "complaint_id")
        .write.mode("overwrite").partitionBy("month").parquet(path)
    )
