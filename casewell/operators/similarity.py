"""Duplicate detection on top of the nearest-neighbour operators.

Ids used for the search should sort in register order (numbers do); attributes such as text
or category are joined afterwards, to the few rows that survived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import MATCH_BANDS, band
from ..functions.text import ellipsis, prefix_key, strip
from ..schema import DUPLICATE_ABOVE, NEAR_COPY
from ..session import materialize
from .vectors import knn


def distinct_pairs(neighbours: DataFrame) -> DataFrame:
    """Each unordered pair once, in the direction of the row that found it first."""
    a, b = F.col("query_id"), F.col("neighbour_id")
    return (
        neighbours.where(a != b)
        .groupBy(F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi"))
        .agg(F.min(F.struct(a.alias("q"), b.alias("n"), F.col("similarity").alias("s")))
             .alias("_first"))
        .select(F.col("_first.q").alias("id_1"), F.col("_first.n").alias("id_2"),
                F.col("_first.s").alias("similarity_score"))
    )


def duplicate_pairs(
    embeddings: DataFrame,
    k: int = 5,
    threshold: float = 0.70,
    max_sim: float | None = NEAR_COPY,
    id_col: str = "id",
    vec_col: str = "embedding",
    **knn_options,
) -> DataFrame:
    """Pairs (id_1, id_2, similarity_score) among the k nearest others of each row, from the
    threshold up to the near-copy cut. The cut comes after the ranking, so exact copies
    take up places. The offline variant is k=3, threshold=0.82, max_sim=None."""
    near = knn(embeddings, embeddings, k, threshold, id_col, vec_col, **knn_options)
    if max_sim is not None:
        near = near.where(F.col("similarity") < max_sim)
    return distinct_pairs(near)


def describe_pairs(pairs: DataFrame, register: DataFrame, key: str = "event_id",
                   digits: int = 3) -> DataFrame:
    """Pairs with ids, clipped texts, category of the first and flag of the second row."""
    text = "complaint_text" in register.columns
    side = register.select(
        F.col(key).alias("_k"), "complaint_id", "category", "is_duplicate",
        *([ellipsis("complaint_text", 80).alias("_text")] if text else []),
    )

    def named(suffix: str) -> DataFrame:
        return side.select(*[F.col(c).alias(f"{c}{suffix}") for c in side.columns])

    out = pairs.join(named("_a"), F.col("id_1") == F.col("_k_a")).join(
        named("_b"), F.col("id_2") == F.col("_k_b")
    )
    shown = F.bround("similarity_score", digits)
    return out.select(
        F.col("complaint_id_a").alias("complaint_id_1"),
        F.col("complaint_id_b").alias("complaint_id_2"),
        *([F.col("_text_a").alias("text_1"), F.col("_text_b").alias("text_2")] if text else []),
        F.col("category_a").alias("category"),
        shown.alias("similarity_score"),
        F.coalesce("is_duplicate_b", F.lit(False)).alias("is_known_dup"),
        band(shown, MATCH_BANDS).alias("match_band"),
    )


def top_pairs(pairs: DataFrame, n: int = 50, *keys: str) -> DataFrame:
    return pairs.orderBy(F.desc("similarity_score"), *(keys or ("id_1", "id_2"))).limit(n)


def dup_pair_stats(described: DataFrame) -> DataFrame:
    known = F.col("is_known_dup")
    return described.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if(known).alias("known"),
        F.count_if(~known).alias("new"),
    )


def top_k_per_query(df: DataFrame, k: int, score: str = "similarity", query: str = "query_id",
                    tie: str = "neighbour_id") -> DataFrame:
    """Best k rows per query. The limit per group is also applied before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_per_text_prefix(df: DataFrame, prefix: str, query: str = "query_id",
                          score: str = "similarity", tie: str = "neighbour_id") -> DataFrame:
    """Best-scoring row per query and text beginning (a column made by `prefix_key`)."""
    w = Window.partitionBy(query, prefix).orderBy(F.desc(score), tie)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def similar(
    queries: DataFrame,
    base: DataFrame,
    texts: DataFrame,
    top_k: int = 3,
    threshold: float = 0.75,
    max_sim: float | None = NEAR_COPY,
    probe: int | None = None,
    exclude_id: str | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    text: str = "complaint_text",
    **knn_options,
) -> DataFrame:
    """Similar complaints for a table of queries (id, vector[, exclude_id]).

    Of the top_k+10 nearest rows those below the threshold, the near copies and the excluded
    id are dropped, then repeated text beginnings, and the best `top_k` stay. `texts` holds
    (id, text, further attributes). Results show the first 120 characters of the text, which
    are cut out before the join, so that whole texts are not shuffled."""
    near = knn(queries, base, probe or top_k + 10, threshold, id_col, vec_col,
               exclude_self=False, **knn_options)
    if max_sim is not None:
        near = near.where(F.col("similarity") < max_sim)
    if exclude_id is not None:
        skip = queries.select(F.col(id_col).alias("query_id"), F.col(exclude_id).alias("_x"))
        near = near.join(skip, "query_id").where(
            ~F.col("_x").eqNullSafe(F.col("neighbour_id"))).drop("_x")
    shown = texts.withColumnRenamed(id_col, "neighbour_id").withColumns({
        "_prefix": prefix_key(text), text: ellipsis(text, 120)})
    found = near.drop("rank").join(shown, "neighbour_id")
    return top_k_per_query(first_per_text_prefix(found, "_prefix"), top_k).drop("_prefix")


def similar_offline(
    queries: DataFrame,
    base: DataFrame,
    top_k: int = 5,
    threshold: float = 0.82,
    id_col: str = "id",
    vec_col: str = "embedding",
    **knn_options,
) -> DataFrame:
    """Offline form: top_k+1 nearest, rounded to four places, copies dropped after rounding,
    no test of text beginnings."""
    near = knn(queries, base, top_k + 1, threshold, id_col, vec_col, exclude_self=False,
               **knn_options)
    rounded = near.withColumn("similarity", F.bround("similarity", 4)).where(
        F.col("similarity") < NEAR_COPY
    )
    return top_k_per_query(rounded, top_k)


def similar_display(df: DataFrame) -> DataFrame:
    """Three decimals, as results are shown."""
    return df.withColumn("similarity", F.bround("similarity", 3))


def duplicate_found(queries: DataFrame, similar_rows: DataFrame, id_col: str = "id",
                    above: float = DUPLICATE_ABOVE) -> DataFrame:
    """Per query: is the best similarity, as displayed, strictly above the limit?"""
    best = similar_rows.groupBy("query_id").agg(
        F.max(F.bround("similarity", 3)).alias("best_similarity"))
    return queries.select(F.col(id_col).alias("query_id")).join(best, "query_id", "left").select(
        "query_id", "best_similarity",
        F.coalesce(F.col("best_similarity") > above, F.lit(False)).alias("duplicate_found"),
    )


def rows_with_near_dup(
    embeddings: DataFrame,
    first_n: int | None = 100,
    k: int = 5,
    low: float = 0.82,
    high: float = NEAR_COPY,
    id_col: str = "id",
    vec_col: str = "embedding",
    **knn_options,
) -> DataFrame:
    """How many of the first n rows by id (all with None) have a near copy among their k."""
    queries = embeddings if first_n is None else embeddings.orderBy(id_col).limit(first_n)
    near = knn(queries, embeddings, k, low, id_col, vec_col, **knn_options)
    return near.where(F.col("similarity") < high).agg(
        F.count_distinct("query_id").alias("rows_with_near_dup"))


def normal_text(text: Column | str) -> Column:
    return F.lower(strip(text))


def exact_duplicates(df: DataFrame, text: str = "complaint_text", key: str = "complaint_id"
                     ) -> DataFrame:
    """Rows whose normalised text occurs more than once: (key, first key of the group, copies).

    Texts are read and hashed once; only (key, hash) is kept. Group sizes are combined before
    the shuffle; groups are stored and joined back as rows, never collected. Each side of that
    join has a shuffle of its own, so the adaptive skew join can split a hot group."""
    hashed = materialize(df.where(F.col(text).isNotNull()).select(
        F.col(key), F.sha2(normal_text(text), 256).alias("_h")))
    groups = materialize(hashed.groupBy("_h").agg(
        F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies")
    ).where(F.col("copies") > 1))
    return hashed.join(groups, "_h").select(key, "first_id", "copies")
