"""File-backed logs fed by streams. A micro-batch writes its own folder, so a repeated batch
replaces itself and nothing is counted twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType,
                files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def write_batch(df: DataFrame, store: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")


def read_store(spark: SparkSession, store: str, schema: StructType,
               before: int | None = None, only: int | None = None) -> DataFrame:
    """The log (up to but without batch `before`, or batch `only`); empty when nothing was
    written yet. Batch filters prune folders."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(conf).exists(path):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(
        StructType([*schema.fields]).add("batch_id", "long")).parquet(store)
    if before is not None:
        log = log.where(log.batch_id < before)
    if only is not None:
        log = log.where(log.batch_id == only)
    return log.drop("batch_id")


def append_batches(stream: DataFrame, store: str,
                   prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataStreamWriter:
    """Append-only log of a stream. Positions per complaint are computed when the log is read
    (`running_number`), so a busy complaint does not pass through one task."""
    return stream.writeStream.foreachBatch(
        lambda df, batch_id: write_batch(prepare(df), store, batch_id))


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process what is there, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
