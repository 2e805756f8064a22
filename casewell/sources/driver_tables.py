"""Views of the driver's tables in the shape of the complaint data model.

The tables hold no complaints, so the register is derived row by row from `events`, texts
from `documents`, message threads from `conversations`, and request logs from filtered
`events`. Every mapping is a projection, hence it grows with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(x: Column, values: list[str], rest: str) -> Column:
    out = F.when(x == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(x == i, v)
    return out.otherwise(rest)


def complaint_key(n: Column) -> Column:
    return F.concat(F.lit("CMP"), n.cast("string"))


def register(spark: SparkSession, sf_dir: str, with_text: bool = False, read=table) -> DataFrame:
    """Complaint register; the text join is added only where it is asked for. `read` opens a
    table, as a batch or as a stream."""
    e, u = F.col("event_id"), F.col("user_id")
    state = (e + u) % 4
    dup = e % 19 == 0
    reg = read(spark, sf_dir, "events").select(
        complaint_key(e).alias("complaint_id"),
        e.alias("event_id"),
        u.alias("user_id"),
        F.col("event_type").alias("category"),
        F.col("ts").cast("timestamp").alias("created_date"),
        _cases(e % 5, ["Angry", "Frustrated", "Neutral", "Disappointed"], "Urgent")
        .alias("sentiment"),
        _cases(e % 4, ["Low", "Medium", "High"], "Critical").alias("severity"),
        _cases(e % 7, ["Email", "Branch Visit", "Phone Call", "Mobile App", "Web Portal"],
               "Social Media").alias("channel"),
        F.concat(F.lit("branch_"), (u % 12).cast("string")).alias("branch"),
        _cases(state, ["Open", "In Progress", "Escalated"], "Resolved").alias("status"),
        F.when(state == 3, (F.lit(1) + e % 15).cast("double")).alias("resolution_days"),
        dup.alias("is_duplicate"),
        F.when(dup & (e > 0), complaint_key(e - 1)).alias("duplicate_of"),
    )
    return attach_text(spark, sf_dir, reg) if with_text else reg


def register_texts(spark: SparkSession, sf_dir: str) -> tuple[Column, DataFrame]:
    """The key of a register row's text, over its event_id, and the texts by that key."""
    docs = table(spark, sf_dir, "documents")
    n_docs = docs.count()
    return F.col("event_id") % n_docs, docs.select(
        F.col("doc_id").alias("text_key"), F.col("text").alias("complaint_text"))


def attach_text(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Register rows with their texts. Cut the rows down first: a text is repeated for each."""
    key, texts = register_texts(spark, sf_dir)
    return rows.withColumn("text_key", key).join(texts, "text_key", "left").drop("text_key")


def communications_log(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Conversation turns as thread messages; late assistant turns count as auto-resolutions."""
    role, turn = F.col("role"), F.col("turn")
    return read(spark, sf_dir, "conversations").select(
        complaint_key(F.col("conv_id")).alias("complaint_id"),
        turn.alias("seq"),
        F.when(role == "user", "customer").when(role == "assistant", "agent")
        .otherwise("system").alias("sender"),
        F.col("text").alias("message"),
        F.lit("Internal").alias("channel"),
        (F.lit("2024-01-31 00:00:00").cast("timestamp")
         + F.make_dt_interval(F.lit(0), F.lit(0), turn.cast("int"))).alias("ts"),
        F.when((role == "assistant") & (turn >= 5), "auto_resolution").alias("type"),
    )


def escalation_requests(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """`error` events as escalation requests; ids repeat, and some name no complaint."""
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return read(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        complaint_key(u * 97).alias("complaint_id"),
        e.alias("seq"),
        F.when(v >= 20, "L1").when(v >= 5, "L2").alias("escalation_level"),
        F.concat(F.lit("props "), F.col("props")).alias("reason"),
        F.concat(F.lit("Desk "), (u % 5).cast("string")).alias("escalated_to"),
        F.lit("Agent").alias("escalated_by"),
        F.col("ts").cast("timestamp").alias("escalated_at"),
    )


def extension_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`signup` events as deadline-extension requests, again with repeats and strangers."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").where(F.col("event_type") == "signup").select(
        complaint_key(u * 61).alias("complaint_id"),
        e.alias("seq"),
        (F.lit(1) + e % 96).cast("int").alias("extend_hours"),
        F.concat(F.lit("requested by user "), u.cast("string")).alias("reason"),
        F.col("ts").cast("timestamp").alias("extended_at"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document labels as resolution verdicts about the complaint with the same number."""
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "labels").select(
        complaint_key(F.col("doc_id")).alias("complaint_id"),
        (q == 1).alias("can_auto_resolve"),
        F.concat(F.lit("quality "), q.cast("string")).alias("reasoning"),
        F.concat(F.lit("toxic "), t.cast("string")).alias("resolution_note"),
    )


def external_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as an external feed with a free-text product."""
    k = F.col("p_partkey")
    product = _cases(
        k % 8,
        ["Credit reporting", "Debt collection", "Mortgage", "Checking or savings account",
         "Credit card", "Money transfer", ""],
        "x",
    )
    return table(spark, sf_dir, "part").select(
        k.alias("feed_id"),
        F.when(k % 8 != 7, product).alias("product"),
        F.col("p_name").alias("text"),
    )
