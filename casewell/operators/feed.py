"""External feeds and labelled duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import contains_any, padded_id


def map_product(product: Column | str) -> Column:
    """Free-text product → category; the first rule that fits wins, null reads as empty."""
    low = F.coalesce(F.col(product) if isinstance(product, str) else product, F.lit(""))
    out = None
    for words, category in S.PRODUCT_RULES:
        hit = contains_any(low, words)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(S.DEFAULT_PRODUCT_CATEGORY)


def feed_rows(feed: DataFrame, source: str = "External") -> DataFrame:
    """Feed (feed_id, product, text) in register columns."""
    return feed.select(
        F.concat(F.lit("EXT"), F.lpad(F.col("feed_id").cast("string"), 6, "0"))
        .alias("complaint_id"),
        F.col("text").alias("complaint_text"),
        map_product("product").alias("category"),
        F.lit(False).alias("is_duplicate"),
        F.lit(source).alias("source"),
    )


def append_feed(register: DataFrame, feed: DataFrame, source: str = "External") -> DataFrame:
    """Bag union; columns that one side lacks are null there."""
    return register.unionByName(feed_rows(feed, source), allowMissingColumns=True)


def id_collisions(register: DataFrame, feed: DataFrame) -> DataFrame:
    """Ids that occur more than once after the append: reported, never overwritten."""
    return (
        append_feed(register, feed).groupBy("complaint_id")
        .agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    )


def _pick(key: str, salt: str, n: int) -> Column:
    """Repeatable number below n from an id."""
    digest = F.md5(F.concat(F.col(key), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint") % n


def inject_duplicates(
    df: DataFrame, n: int = 30, first_id: int = 9001, prefix: str = "CMP",
    channels: Sequence[str] = tuple(S.CHANNELS), salt: str = "dup",
) -> DataFrame:
    """Register plus n flagged copies of n originals, under new ids, through another
    channel and one to three days later. The pick is by hash, hence repeatable."""
    chosen = df.orderBy(F.md5(F.concat("complaint_id", F.lit(salt))), "complaint_id").limit(n)
    # n rows at most reach this window
    order = Window.partitionBy(F.lit(1)).orderBy("complaint_id")
    copies = chosen.withColumns({
        "_id": padded_id(F.row_number().over(order) - 1 + first_id, prefix),
        "channel": F.element_at(F.array(*[F.lit(c) for c in channels]),
                                (_pick("complaint_id", salt + "c", len(channels)) + 1)
                                .cast("int")),
        "created_date": F.col("created_date") + F.make_dt_interval(
            (_pick("complaint_id", salt + "d", 3) + 1).cast("int")),
        "is_duplicate": F.lit(True),
        "duplicate_of": F.col("complaint_id"),
    }).withColumn("complaint_id", F.col("_id")).drop("_id")
    return df.unionByName(copies)
