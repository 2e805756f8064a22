"""Shards of bounded size by extendible hashing.

A document's key is the first 60 bits of an MD5 digest of its id. The directory is indexed by
prefixes of the key: a bucket over the byte limit is split on its next bit, and only such a
bucket, until every shard fits. Sizes are summed once in fine cells of the key space, whose
prefixes are summed up; deeper bits are read only for cells that are still too large. Equal
keys (repeated ids) are parted by further bits of a number each row has."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Bytes of text in a shard, bits of the key, and bits more than an even split needs that the
#: first sizing looks at.
SHARD_BYTES, KEY_BITS, SPARE_BITS = 1 << 20, 60, 3
#: Bits of the row number's digest that part equal keys.
ROW_BITS = 60


def key_of(col: Column) -> Column:
    """First 60 bits of the MD5 digest of a value's text, null as empty."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def prefix(key: Column, row: Column, depth: int | Column) -> Column:
    """The first `depth` bits of key and row key as binary digits."""
    digits = F.concat(F.lpad(F.conv(key.cast("string"), 10, 2), KEY_BITS, "0"),
                      F.lpad(F.conv(row.cast("string"), 10, 2), ROW_BITS, "0"))
    return F.substring(digits, F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """(cell, bits, depth, shard, shard_bytes, shard_rows): the leaf that each cell belongs to.

    `sized` has (key, row, bytes). A leaf is the shortest prefix whose bytes fit the limit, or
    a single row beyond it."""
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    bits = min(KEY_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    level, upper, out = sized, 0, None
    while True:
        cells = materialize(level.groupBy(prefix(F.col("key"), F.col("row"), bits).alias("cell"))
                            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")))
        sums = (cells.select("bytes", "rows", F.explode(F.sequence(F.lit(upper), F.lit(bits)))
                             .alias("depth"), "cell")
                .groupBy("depth", F.substring("cell", F.lit(1), F.col("depth")).alias("shard"))
                .agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
                .where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)))
        fits = materialize(sums)
        leaves = (cells.select("cell", F.explode(F.sequence(F.lit(upper), F.lit(bits))).alias("depth"))
                  .select("cell", "depth", F.substring("cell", F.lit(1), F.col("depth")).alias("shard"))
                  .join(fits, ["depth", "shard"])
                  .groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes",
                                                      "shard_rows")).alias("leaf"))
                  .select("cell", F.lit(bits).alias("bits"), "leaf.*"))
        leaves = materialize(leaves)
        out = leaves if out is None else out.unionByName(leaves)
        large = materialize(cells.join(leaves, "cell", "left_anti").select("cell"))
        if large.isEmpty() or bits == KEY_BITS + ROW_BITS:
            return out
        level = (level.withColumn("cell", prefix(F.col("key"), F.col("row"), bits))
                 .join(large, "cell", "left_semi").drop("cell"))
        upper, bits = bits + 1, min(bits + 8, KEY_BITS + ROW_BITS)


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, depth, shard, shard_bytes, shard_rows.

    `shard` is the binary prefix of the directory (empty when one shard holds all). Sizes are
    UTF-8 bytes of the text, null as none. Every shard holds at most `limit` bytes, except that
    a single row above the limit is a shard of its own. Null ids share a key; they and repeated
    ids are parted by row. An empty table gives an empty result; other columns are not looked
    at."""
    if limit < 1:
        raise ValueError("limit must be positive")
    sized = materialize(docs.select(
        F.col(id_col).alias("doc_id"), key_of(F.col(id_col)).alias("key"),
        key_of(F.monotonically_increasing_id()).alias("row"),
        F.octet_length(text_of(text_col)).cast("bigint").alias("bytes")))
    leaves = directory(sized.select("key", "row", "bytes"), limit)
    out = None
    for bits in sorted(r.bits for r in leaves.select("bits").distinct().collect()):
        part = (sized.withColumn("cell", prefix(F.col("key"), F.col("row"), bits))
                .join(leaves.where(F.col("bits") == bits), "cell")
                .select("doc_id", F.col("bytes").alias("n_bytes"), F.col("depth").cast("bigint")
                        .alias("depth"), "shard", "shard_bytes", "shard_rows"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else sized.select(
        "doc_id", F.col("bytes").alias("n_bytes"), F.lit(0).cast("bigint").alias("depth"),
        F.lit("").alias("shard"), F.col("bytes").alias("shard_bytes"),
        F.lit(0).cast("bigint").alias("shard_rows"))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row into the folder of its shard (rows repeated with one id go to the first
    of its shards)."""
    where = (assign_shards(docs, limit, id_col, text_col)
             .groupBy(F.col("doc_id").alias("__id")).agg(F.min("shard").alias("shard")))
    (docs.join(where, docs[id_col].eqNullSafe(where["__id"])).drop("__id")
     .repartition("shard").write.partitionBy("shard").parquet(path))
