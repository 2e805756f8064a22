"""Helpers shared by the operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewell.session import checkpoint_root, materialize, scratch_path  # noqa: F401

#: White space between words, as in the quality and shingle definitions.
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_bytes(col: str = "text") -> Column:
    """The UTF-8 bytes of a text with null as empty."""
    return text_of(col).cast("binary")


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spill_folder() -> str | None:
    """Where a running task may put files that only this task reads, like Spark's own spill
    files: the executor's local folders. They are gone when the task ends."""
    first = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0].strip()
    return first if first and os.path.isdir(first) else None
