"""Policy corpus: folders of text files, and chunk metadata as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """One row (source, text) per `.txt` file of the folder."""
    return (
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
        .select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select("source", "chunk_id", "text").write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str, array_form: bool = False) -> DataFrame:
    """Chunk metadata, one JSON object per line or (array_form) one JSON array per file."""
    return spark.read.schema(S.CHUNK_SCHEMA).option("multiLine", array_form).json(path)
