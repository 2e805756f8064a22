"""Last write per key as a table that a stream keeps: a log of micro-batches with snapshots.

A batch writes its own rows only. After `every` batches the snapshot before and the batches since
are merged into a new one (last write per key), spread over files by key, so that a reader takes
one snapshot and fewer than `every` batches however long the stream has run. A snapshot counts
from the moment its row is in the manifest, which is written after its files: a run that is lost
halfway leaves files that nobody reads, and a repeated batch replaces its own folder and changes
nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.events import latest_per_id

MANIFEST = "upto long, path string"


def _read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a Parquet folder; none where it is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def newest_snapshot(spark: SparkSession, store: str, before: int | None = None
                    ) -> tuple[int, str | None]:
    """(last batch of the newest snapshot, its path); (-1, None) without one."""
    rows = _read(spark, f"{store}/manifest", MANIFEST)
    if before is not None:
        rows = rows.where(F.col("upto") < before)
    found = rows.agg(F.max_by(F.struct("upto", "path"), "upto").alias("m")).first().m
    return (found.upto, found.path) if found else (-1, None)


def read_latest(spark: SparkSession, store: str, schema: StructType, key: str = "complaint_id",
                seq: str = "seq", before: int | None = None) -> DataFrame:
    """The last write of each key by `seq` (up to but without batch `before`). Keys and numbers
    may come in any order and in any batch; a null key is a key."""
    return latest_per_id(_rows(spark, store, schema, *newest_snapshot(spark, store, before),
                               before), key, seq).select(schema.names)


def _rows(spark: SparkSession, store: str, schema: StructType, upto: int, path: str | None,
          before: int | None) -> DataFrame:
    """A snapshot and the batches after it."""
    log = _read(spark, f"{store}/log", StructType([*schema.fields]).add("batch_id", "long"))
    log = log.where(F.col("batch_id") > upto)  # prunes folders
    if before is not None:
        log = log.where(F.col("batch_id") < before)
    rows = log.select(schema.names)
    return rows if path is None else spark.read.schema(schema).parquet(
        f"{store}/{path}").unionByName(rows)


def upsert_batch(batch: DataFrame, batch_id: int, store: str, key: str = "complaint_id",
                 seq: str = "seq", every: int = 8, files: int = 16) -> None:
    """Store a micro-batch, and merge where a snapshot is due."""
    spark, schema = batch.sparkSession, batch.schema
    latest_per_id(batch, key, seq).select(schema.names).write.mode("overwrite").parquet(
        f"{store}/log/batch_id={batch_id}")
    # of earlier batches only: a repeated batch writes its snapshot anew, from the same rows
    upto, before = newest_snapshot(spark, store, before=batch_id)
    if batch_id - upto < every:
        return
    path = f"snapshot/upto={batch_id}"
    rows = _rows(spark, store, schema, upto, before, batch_id + 1)
    latest_per_id(rows, key, seq).select(schema.names).repartition(files, key).write.mode("overwrite").parquet(f"{store}/{path}")
    spark.createDataFrame([(batch_id, path)], MANIFEST).coalesce(1).write.mode("append").parquet(
        f"{store}/manifest")


def upsert_batches(stream: DataFrame, store: str, **options) -> DataStreamWriter:
    """Keep the last write per key of a stream in `store`."""
    return stream.writeStream.foreachBatch(
        lambda df, batch_id: upsert_batch(df, batch_id, store, **options))


def bytes_to_read(spark: SparkSession, store: str, schema: StructType) -> int:
    """Bytes of the files that `read_latest` opens now."""
    upto, path = newest_snapshot(spark, store)
    parts = [f"{store}/log/batch_id={b}" for b, in _read(
        spark, f"{store}/log", StructType([*schema.fields]).add("batch_id", "long"))
        .select("batch_id").where(F.col("batch_id") > upto).distinct().collect()]
    parts += [f"{store}/{path}"] if path else []
    if not parts:
        return 0
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(parts)
    return listed.agg(F.sum("length")).first()[0] or 0
