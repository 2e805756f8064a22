"""Registered queries: every operator over the driver's tables, with its check in SQL.

A query without SQL is one that SQL cannot express (models, hashed vectors, streams); its
operator is tested against brute force or batch results in `tests/`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sql as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
AS_OF = X.AS_OF


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name."""
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the tables hold zone-less times, which are read as UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain_types(fn(spark, sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        _QUERIES[fn.__name__] = run
        if sql is not None:
            _SQL[fn.__name__] = sql
        return run
    return wrap


def plain_types(df: DataFrame) -> DataFrame:
    """Integers as 64-bit numbers, so that both engines return the same types."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select([
        F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from . import (  # noqa: F401
        q_events, q_functions, q_policy, q_register, q_rules, q_similarity, q_sla, q_stats,
        q_streaming, q_text,
    )
