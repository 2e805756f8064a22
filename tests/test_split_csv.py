"""Quoted CSV read in small blocks against the reader of whole files."""

import random

import pytest
from pyspark.sql import types as T

from casewell import sources as src

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("x", T.DoubleType())])


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in kept:
        spark.conf.set(k, "700")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def text(rng):
    return "".join(rng.choice(['a', 'é', ' ', ',', '\n', '""', '\n\n', 'b'])
                   for _ in range(rng.randrange(1, 40)))


def test_equals_the_reader_of_whole_files(spark, tmp_path, small_blocks):
    rng = random.Random(5)
    for name in ("a", "b"):
        rows = [f'{i},"x{text(rng)}y",{i}.5' for i in range(400)]
        rows[100] = '100,"' + 'long\n' * 900 + '",1.0'  # a record over many blocks
        (tmp_path / f"{name}.csv").write_text("id,text,x\n" + "\n".join(rows) + "\n\n7,,\n")
    path = str(tmp_path)
    rows, broken = src.read_split_csv(spark, path, SCHEMA)
    want = (spark.read.schema(SCHEMA).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, want.collect()))
    assert broken.collect() == [] and rows.count() == 802
    assert src.csv_records(spark, path).rdd.getNumPartitions() > 20


def test_broken_records_are_returned(spark, tmp_path, small_blocks):
    p = tmp_path / "r.csv"
    p.write_bytes(b'id,text,x\r\n1,"a\r\nb",2\r\n2,b\r\nseven,c,1\r\n3,d,4,5\r\n4,e,\r\n5,"open,1\r\n6,x,1')
    rows, broken = src.read_split_csv(spark, str(p), SCHEMA)
    assert sorted((r.id, r.x) for r in rows.collect()) == [(1, 2.0), (4, None)]
    assert {r.text.split(",")[0] for r in broken.collect()} == {"2", "seven", "3", "5"}


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,text,x\n")
    rows, broken = src.read_split_csv(spark, str(tmp_path), SCHEMA)
    assert rows.collect() == [] == broken.collect()
