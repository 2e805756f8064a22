"""Quoted CSV files read by many tasks, and the records that do not fit the schema.

A line break inside quotes ends no record, so a task that starts inside a file has to know whether
it starts inside quotes. The text reader deals out blocks of lines; a first pass takes the parity
of the quotes of each block, running sums of them (one row a block) tell how each block starts, and
a second pass cuts each block at true record borders. The parts of a record that crosses blocks,
two a block at most, are put together by their place in the file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = "file string, at bigint, odd int"
PARTS = "file string, at bigint, no bigint, text string, joins boolean, open boolean"


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.count_substring(values, '"'), 0).to_numpy(zero_copy_only=False)


def _parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes modulo two of each block that a task reads."""
    odd: dict = {}
    for batch in batches:
        table = pa.table({"file": batch.column(0), "at": batch.column(1),
                          "n": pa.array(_quotes(batch.column(2)))})
        for r in table.group_by(["file", "at"]).aggregate([("n", "sum")]).to_pylist():
            key = r["file"], r["at"]
            odd[key] = (odd.get(key, 0) + r["n_sum"]) % 2
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in odd], pa.string()), pa.array([k[1] for k in odd], pa.int64()),
         pa.array(list(odd.values()), pa.int32())], names=["file", "at", "odd"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records of each block, lines in the order of the file."""
    block, lines, inside, no, joins = None, [], False, 0, False

    def part() -> tuple:
        return (*block, no, "\n".join(lines), joins, inside)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["file", "at", "no", "text", "joins", "open"])

    for batch in batches:
        out = []
        files, starts, values, within = (batch.column(i).to_pylist() for i in range(4))
        for file, at, line, start, odd in zip(
                files, starts, values, within, _quotes(batch.column(2)) % 2, strict=True):
            if (file, at) != block:
                if lines:
                    out.append(part())
                block, lines, no, inside, joins = (file, at), [], 0, start, start
            lines.append(line)
            inside ^= bool(odd)
            if not inside:
                out.append(part())
                lines, joins, no = [], False, no + 1
        yield made(out)
    if lines:
        yield made([part()])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, no, text, open) of each record of the CSV files: the block and the number in it
    where the record starts, its text without the line break that ends it, and whether the file
    ends inside its quotes. Blank records are left out."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"), "value")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(  # one row a block
        Window.unboundedPreceding, -1)
    starts = lines.mapInArrow(_parity, BLOCKS).select(
        "file", "at", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # one row for each spark.sql.files.maxPartitionBytes of input; order of lines is kept
    known = lines.join(F.broadcast(starts.where("inside")), ["file", "at"], "left").select(
        "file", "at", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    parts = known.mapInArrow(_cut, PARTS)
    whole = parts.where("not joins and not open").select("file", "at", "no", "text", "open")
    order = Window.partitionBy("file").orderBy("at", "no")
    crossing = parts.where("joins or open").withColumn(
        "record", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    place = F.struct("at", "no", "text", "open")
    joined = crossing.groupBy("file", "record").agg(F.sort_array(F.collect_list(place)).alias("p"))
    joined = joined.select("file", F.col("p")[0]["at"].alias("at"), F.col("p")[0]["no"].alias("no"),
                           F.array_join(F.col("p")["text"], "\n").alias("text"),
                           F.element_at("p", -1)["open"].alias("open"))
    return whole.unionAll(joined).withColumn("text", F.regexp_replace("text", r"\r\z", "")).where(
        "trim(text) <> ''")


def read_split_csv(spark: SparkSession, path: str,
                   schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema, (file, at, no, text) of the records that do not fit it) of CSV files
    with a header each. Empty fields are null. A record does not fit when it has another number of
    fields, a value of another type, or a quote that the file never closes."""
    bad = "__broken_record"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    body = csv_records(spark, path).where("not (at = 0 and no = 0)")
    parsed = body.withColumn("r", F.from_csv("text", _ddl(wide), {
        "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    broken = F.col("open") | F.col(f"r.{bad}").isNotNull()
    return (parsed.where(~broken).select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields]),
            parsed.where(broken).select("file", "at", "no", "text"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
