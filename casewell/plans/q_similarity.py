"""Nearest neighbours and duplicates. The vectors of the tables are far apart, so thresholds
are lower here than the defaults of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as src
from ..operators import setjoin
from ..operators import similarity as sim
from ..operators.vectors import knn, knn_lsh, l2_normalize
from . import sql as X
from .catalog import query

LOW = 0.40


def _vectors(spark, d):
    return src.read_embeddings(spark, f"{d}/embeddings.parquet", "vec_id")


def _rounded(df, column="similarity"):
    return df.withColumn(column, F.round(column, 6))


@query(X.with_(X.NN) + "SELECT query_id, neighbour_id, round(similarity, 6) AS similarity, rank "
       "FROM nn WHERE rank <= 5")
def knn_exact(spark, d):
    return _rounded(knn(_vectors(spark, d), _vectors(spark, d), 5))


@query(X.with_(X.NN) + "SELECT query_id, neighbour_id, round(similarity, 6) AS similarity, rank "
       f"FROM nn WHERE rank <= 5 AND similarity >= {LOW}")
def knn_exact_blocked(spark, d):
    """Small pieces and a threshold."""
    vec = _vectors(spark, d)
    return _rounded(knn(vec, vec, 5, LOW, block_rows=512))


@query()
def knn_hashed(spark, d):
    """A pair at LOW is met with probability 0.984, nearer ones more often."""
    vec = _vectors(spark, d)
    return _rounded(knn_lsh(vec, vec, 5, LOW, tables=24, bits=4))


@query(X.with_(X.UNIT) + """SELECT vec_id AS id, len(e) AS dim,
  round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total FROM u""")
def l2_normalized(spark, d):
    return _vectors(spark, d).select("id", l2_normalize("embedding").alias("v")).select(
        "id", F.size("v").alias("dim"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(X.with_(X.pairs(5, LOW, 0.9999)) + "SELECT id_1, id_2, round(similarity_score, 6) "
       "AS similarity_score FROM prs")
def duplicate_pairs(spark, d):
    return _rounded(sim.duplicate_pairs(_vectors(spark, d), 5, LOW), "similarity_score")


@query(X.with_(X.pairs(3, LOW, None)) + "SELECT id_1, id_2, round(similarity_score, 6) "
       "AS similarity_score FROM prs")
def duplicate_pairs_offline(spark, d):
    return _rounded(sim.duplicate_pairs(_vectors(spark, d), 3, LOW, None), "similarity_score")


_DESCRIBED = X.with_(X.REG, X.TXT, X.pairs(5, LOW, 0.9999)) + """, desc_ AS (
SELECT a.complaint_id AS complaint_id_1, b.complaint_id AS complaint_id_2,
  concat(substr(a.complaint_text, 1, 80), '...') AS text_1,
  concat(substr(b.complaint_text, 1, 80), '...') AS text_2, a.category,
  round(similarity_score, 3) AS similarity_score, b.is_duplicate AS is_known_dup,
  CASE WHEN round(similarity_score, 3) >= 0.95 THEN 'Critical Match'
    WHEN round(similarity_score, 3) >= 0.90 THEN 'High Match'
    WHEN round(similarity_score, 3) >= 0.82 THEN 'Moderate Match' ELSE 'Low Match' END
    AS match_band
FROM prs JOIN txt a ON a.event_id = id_1 JOIN txt b ON b.event_id = id_2)
"""


def with_vector(spark, d):
    """Register rows with a vector; texts are read for these only."""
    ids = _vectors(spark, d).select(F.col("id").alias("event_id"))
    rows = src.register(spark, d).join(ids, "event_id", "left_semi")
    return src.attach_text(spark, d, rows)


def _described(spark, d):
    pairs = sim.duplicate_pairs(_vectors(spark, d), 5, LOW)
    return sim.describe_pairs(pairs, with_vector(spark, d))


@query(_DESCRIBED + "SELECT * FROM desc_")
def described_pairs(spark, d):
    return _described(spark, d)


@query(_DESCRIBED + "SELECT * FROM desc_ ORDER BY similarity_score DESC, complaint_id_1, "
       "complaint_id_2 LIMIT 10")
def top_pairs(spark, d):
    return sim.top_pairs(_described(spark, d), 10, "complaint_id_1", "complaint_id_2")


@query(_DESCRIBED + "SELECT count(*) AS total_pairs, count(*) FILTER (is_known_dup) AS known, "
       "count(*) FILTER (NOT is_known_dup) AS new FROM desc_")
def dup_pair_stats(spark, d):
    return sim.dup_pair_stats(_described(spark, d))


_SIMILAR = X.with_(X.REG, X.TXT, X.NNSELF) + r""", near AS (
SELECT * FROM nns WHERE rank <= 13 AND similarity >= 0.35 AND similarity < 0.9999
  AND query_id <> neighbour_id),
named AS (SELECT n.query_id, n.neighbour_id, n.similarity, t.complaint_id, t.category, t.severity,
  t.complaint_text, lower(regexp_replace(substr(t.complaint_text, 1, 60), '^\s+|\s+$', '', 'g'))
  AS p FROM near n JOIN txt t ON t.event_id = n.neighbour_id),
firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY query_id, p
  ORDER BY similarity DESC, neighbour_id) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY similarity DESC, neighbour_id) AS rank FROM firsts
  QUALIFY row_number() OVER (PARTITION BY query_id
    ORDER BY similarity DESC, neighbour_id) <= 3)
"""


def similar_rows(spark, d):
    vec = _vectors(spark, d)
    texts = with_vector(spark, d).select(
        F.col("event_id").alias("id"), "complaint_id", "category", "severity", "complaint_text")
    return sim.similar(vec.withColumn("own", F.col("id")), vec, texts, 3, 0.35, exclude_id="own")


@query(_SIMILAR + "SELECT query_id, complaint_id, concat(substr(complaint_text, 1, 120), '...') "
       "AS complaint_text, category, severity, rank FROM best")
def similar_complaints(spark, d):
    shown = sim.similar_display(similar_rows(spark, d))
    return shown.select("query_id", "complaint_id", "complaint_text", "category", "severity",
                        "rank")


@query(_SIMILAR + "SELECT query_id, neighbour_id, rank FROM best")
def top_k_per_query(spark, d):
    return similar_rows(spark, d).select("query_id", "neighbour_id", "rank")


@query(X.with_(X.NNSELF) + f""", near AS (SELECT query_id, neighbour_id,
  round(similarity, 4) AS similarity FROM nns WHERE rank <= 6 AND similarity >= {LOW}),
kept AS (SELECT * FROM near WHERE similarity < 0.9999)
SELECT query_id, neighbour_id, row_number() OVER (PARTITION BY query_id
  ORDER BY similarity DESC, neighbour_id) AS rank FROM kept
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) <= 5""")
def similar_offline(spark, d):
    vec = _vectors(spark, d)
    return sim.similar_offline(vec, vec, 5, LOW).select("query_id", "neighbour_id", "rank")


@query(_SIMILAR + """SELECT v.vec_id AS query_id,
  coalesce(max(round(similarity, 3)) > 0.44, false) AS duplicate_found
FROM embeddings v LEFT JOIN best ON best.query_id = v.vec_id GROUP BY 1""")
def duplicate_found(spark, d):
    return sim.duplicate_found(_vectors(spark, d), similar_rows(spark, d), above=0.44).drop(
        "best_similarity")


@query(X.with_(X.NN) + "SELECT count(DISTINCT query_id) AS rows_with_near_dup FROM nn "
       f"WHERE rank <= 5 AND similarity >= {LOW} AND similarity < 0.9999")
def rows_with_near_dup(spark, d):
    return sim.rows_with_near_dup(_vectors(spark, d), None, 5, LOW)


@query(r"""WITH h AS (SELECT doc_id,
  sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS first_id, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, first_id, copies FROM h JOIN g USING (h)""")
def exact_duplicates(spark, d):
    return sim.exact_duplicates(src.table(spark, d, "documents"), "text", "doc_id")




_SETS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')),
  '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5
  THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
m AS (SELECT doc_id, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END
  AS class_id FROM s),
e AS (SELECT doc_id AS id, len(s) AS n, unnest(s) AS x FROM m WHERE doc_id = class_id),
p AS (SELECT a.id AS id_1, b.id AS id_2, count(*) AS shared, min(a.n) + min(b.n) - count(*) AS u
  FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT id_1, id_2, shared, shared / u AS similarity FROM p WHERE shared / u >= 0.8)
"""


def _sets(spark, d):
    return setjoin.hashed_shingles(src.table(spark, d, "documents"), "doc_id", "text")


@query(_SETS + "SELECT id_1, id_2, shared, round(similarity, 6) AS similarity FROM l")
def similar_texts(spark, d):
    """Links between different texts of 0.8 or more on shingles of five words."""
    return _rounded(setjoin.similar_sets(_sets(spark, d), "id", "s", hashed=True)[0])


@query(_SETS + """, k AS (SELECT id, count(*) AS n FROM (SELECT id_1 AS id FROM l
  UNION ALL SELECT id_2 FROM l) GROUP BY 1)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM m LEFT JOIN k ON k.id = class_id""")
def similar_text_classes(spark, d):
    """The class of equal shingles of each document, and the number of its links."""
    links, members = setjoin.similar_sets(_sets(spark, d), "id", "s", hashed=True)
    ends = links.select(F.explode(F.array("id_1", "id_2")).alias("class_id"))
    return members.join(ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")), "class_id",
                        "left").select(F.col("id").alias("doc_id"), "class_id",
                                       F.coalesce("n", F.lit(0)).alias("n_links"))


@query()
def shingle_recall(spark, d):
    """What the hashed form finds of the exact links of ids divisible by 50."""
    return setjoin.hashed_recall(_sets(spark, d), "id", "s", hashed=True,
                                 queries=(F.col("id_1") % 50 == 0) | (F.col("id_2") % 50 == 0))
