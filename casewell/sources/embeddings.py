"""Embeddings are keyed rows (id, vector), joined by id and never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_embeddings(
    spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "embedding"
) -> DataFrame:
    return spark.read.parquet(path).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("embedding")
    )


def write_embeddings(df: DataFrame, path: str) -> None:
    df.select("id", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)
