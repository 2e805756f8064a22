"""Background agents as micro-batches: triage of arriving complaints and the periodic
resolution run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.events import auto_triage, triage_messages
from ..operators.filters import low_risk_candidates
from ..operators.sla import Clock
from .stores import read_store, write_batch

TRIAGE_LOG = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("escalation_level", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("escalated_to", T.StringType()),
    T.StructField("escalated_by", T.StringType()),
    T.StructField("escalated_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
])
RESOLUTION_LOG = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("resolution_note", T.StringType()),
])


def newest(batch: DataFrame) -> DataFrame:
    """The newest row of each complaint; of equal times the one with the largest hash."""
    order = Window.partitionBy("complaint_id").orderBy(
        F.desc("created_date"), F.desc(F.xxhash64(*batch.columns)))
    return batch.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def triage_batch(batch: DataFrame, batch_id: int, as_of: Clock, store: str, messages: str
                 ) -> None:
    """Escalate what the batch adds. Complaints escalated by earlier batches are skipped, and
    a repeated batch overwrites its own folder only."""
    spark = batch.sparkSession
    done = read_store(spark, store, TRIAGE_LOG, before=batch_id)
    new = auto_triage(newest(batch), as_of, done)
    write_batch(new, store, batch_id)
    written = read_store(spark, store, TRIAGE_LOG, only=batch_id)
    write_batch(triage_messages(written), messages, batch_id)


def run_triage(complaints: DataFrame, as_of: Clock, store: str, messages: str
               ) -> DataStreamWriter:
    return complaints.writeStream.foreachBatch(
        lambda df, i: triage_batch(df, i, as_of, store, messages))


def resolution_tick(register: DataFrame, verdicts: DataFrame, log: DataFrame,
                    limit: int | None = 2, **candidate_options) -> DataFrame:
    """Next complaints to resolve: candidates with a positive verdict that are not in the log,
    in id order, `limit` per run. What a run leaves is taken by the next runs."""
    open_ones = low_risk_candidates(register, limit=None, **candidate_options)
    granted = verdicts.where("can_auto_resolve").groupBy("complaint_id").agg(
        F.max(F.struct("reasoning", "resolution_note")).alias("_v"))
    todo = (
        granted.join(open_ones.select("complaint_id"), "complaint_id", "left_semi")
        .join(log.select("complaint_id"), "complaint_id", "left_anti")
        .select("complaint_id", "_v.*")
    )
    return todo if limit is None else todo.orderBy("complaint_id").limit(limit)


def run_resolution_agent(
    ticks: DataFrame, register: DataFrame, verdicts: DataFrame, store: str,
    limit: int | None = 2, **candidate_options,
) -> DataStreamWriter:
    """One run per micro-batch of `ticks`; use `.trigger(processingTime="60 seconds")` for a
    periodic agent."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        log = read_store(spark, store, RESOLUTION_LOG, before=batch_id)
        write_batch(resolution_tick(register, verdicts, log, limit, **candidate_options), store,
                    batch_id)

    return ticks.writeStream.foreachBatch(step)
