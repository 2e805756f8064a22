"""Clusters of duplicate complaints: connected components over stored and found links.

Components come from alternating large-star and small-star steps: each node looks at its
neighbours and sends those above it (large star), then those below it (small star), to the least
of them, until every component is a star around its smallest id. Both steps are one minimum per
node (combined before the shuffle) and one join; the minima are stored first, so that the adaptive
skew join can split the links of a busy node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def links(register: DataFrame, *pairs: DataFrame) -> DataFrame:
    """(a, b) from `duplicate_of` and from tables of (complaint_id_1, complaint_id_2). Links to
    or from complaints that the register does not have are left out."""
    ids = register.select("complaint_id")
    stored = register.select(F.col("complaint_id").alias("a"), F.col("duplicate_of").alias("b"))
    found = [p.select(F.col("complaint_id_1").alias("a"), F.col("complaint_id_2").alias("b"))
             for p in pairs]
    known = reduce(DataFrame.unionAll, found, stored).where("a is not null and b is not null")
    for end in ("a", "b"):
        known = known.join(ids.withColumnRenamed("complaint_id", end), end, "left_semi")
    return known.select("a", "b")


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected links (a > b)."""
    around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    looking = around if large else edges
    least = materialize(looking.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m")))
    joined = looking.join(least, "a")
    moved = joined.where("b > a" if large else "b <> m").select(F.col("b").alias("a"),
                                                               F.col("m").alias("b"))
    if not large:
        moved = moved.unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of the links (a, b); a component is named by its smallest id.
    Loops, repeated links and links with a null end add nothing."""
    stars = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(stars)
    while True:
        stars = materialize(_step(_step(stars, True), False))
        after = _state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def duplicate_clusters(register: DataFrame, *pairs: DataFrame) -> DataFrame:
    """(complaint_id, cluster, size, first_id) of every complaint that has a duplicate: the
    smallest id of its cluster, the number of members and the member created first (of equal
    times, or without any, the smallest id). Ids of the register are unique."""
    members = materialize(components(links(register, *pairs)).select(
        F.col("id").alias("complaint_id"), F.col("component").alias("cluster")))
    dated = members.join(register.select("complaint_id", "created_date"), "complaint_id")
    order = F.struct(F.col("created_date").isNull(), "created_date", "complaint_id")
    about = materialize(dated.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("complaint_id", order).alias("first_id")))
    return members.join(about, "cluster").select("complaint_id", "cluster", "size", "first_id")
