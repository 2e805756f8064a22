"""Term statistics, labels, splits, classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as src
from ..operators import classify as cl
from ..operators import encode
from ..session import scratch_path
from ..sources.models import load_models, save_models
from . import sql as X
from .catalog import query

STOP = ["the", "of", "and", "to", "in", "de", "la", "und", "der", "les"]


def _docs(spark, d):
    return src.table(spark, d, "documents")


@query("SELECT lang AS label, row_number() OVER (ORDER BY lang) - 1 AS index FROM "
       "(SELECT DISTINCT lang FROM documents)")
def label_index(spark, d):
    return cl.label_index(_docs(spark, d), "lang")


@query("SELECT lang AS label, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * "
       "count(*)) AS weight FROM documents GROUP BY 1")
def class_weights(spark, d):
    return cl.class_weights(_docs(spark, d), "lang")


@query("SELECT lang, count(*) AS rows, cast(round(count(*) * 0.2) AS bigint) AS test_rows "
       "FROM documents GROUP BY 1")
def stratified_split(spark, d):
    """The split itself is by hash; its sizes per label are fixed."""
    return cl.stratified_split(_docs(spark, d), "lang", "doc_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))


@query(X.with_(X.term_ctes()) + "SELECT term, count, df, round(idf, 9) AS idf FROM idf")
def tfidf_vocabulary(spark, d):
    docs = _docs(spark, d)
    vocab = cl.vocabulary(cl.term_stats(docs, "text"), docs.count())
    return vocab.withColumn("idf", F.round("idf", 9))


def _weights(damped: bool) -> str:
    w = "(1.0::DOUBLE + ln(tf::DOUBLE)) * idf" if damped else "tf::DOUBLE * idf"
    return f""", raw AS (SELECT doc_id, term, {w} AS w FROM tf JOIN idf USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 7) AS weight
FROM raw"""


@query(X.with_(X.term_ctes()).rstrip() + _weights(False))
def tfidf_plain(spark, d):
    """All words, plain counts."""
    return cl.tfidf_weights(_docs(spark, d), "text", "doc_id", sublinear=False).withColumn(
        "weight", F.round("weight", 7))


@query(X.with_(X.term_ctes(STOP)).rstrip() + _weights(True))
def tfidf_sublinear(spark, d):
    """Stop words removed, damped counts."""
    return cl.tfidf_weights(_docs(spark, d), "text", "doc_id", STOP).withColumn(
        "weight", F.round("weight", 7))


def _guess(df):
    """A rule as a stand-in for a classifier, so that reports can be checked in SQL."""
    text = F.lower("text")
    return df.withColumn(
        "guess",
        F.when(text.contains(" the "), "en").when(text.contains(" der "), "de")
        .when(text.contains(" les "), "fr").otherwise("es"))


GUESS = """WITH p AS (SELECT lang AS label, CASE WHEN contains(lower(text), ' the ') THEN 'en'
  WHEN contains(lower(text), ' der ') THEN 'de' WHEN contains(lower(text), ' les ') THEN 'fr'
  ELSE 'es' END AS guess FROM documents)"""


@query(GUESS + "SELECT count(*) FILTER (label = guess)::DOUBLE / count(*)::DOUBLE AS accuracy "
       "FROM p")
def accuracy(spark, d):
    return cl.accuracy(_guess(_docs(spark, d)), "lang", "guess")


@query(GUESS + """, c AS (SELECT label AS class FROM p UNION SELECT guess FROM p),
m AS (SELECT class, (SELECT count(*) FROM p WHERE label = class AND guess = class)::DOUBLE AS tp,
  (SELECT count(*) FROM p WHERE guess = class)::DOUBLE AS predicted,
  (SELECT count(*) FROM p WHERE label = class) AS support FROM c),
s AS (SELECT class, coalesce(CASE WHEN predicted > 0 THEN tp / predicted END, 0) AS precision,
  coalesce(CASE WHEN support > 0 THEN tp / support END, 0) AS recall,
  coalesce(CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) END, 0) AS f1,
  support FROM m)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  support FROM s
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
  cast(sum(support) AS bigint) FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
  round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
  cast(sum(support) AS bigint) FROM s""")
def classification_report(spark, d):
    report = cl.classification_report(_guess(_docs(spark, d)), "lang", "guess")
    return report.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
                         "support")


@query()
def train_and_report(spark, d):
    """Language classifier on four fifths of the documents, report on the rest."""
    split = cl.stratified_split(_docs(spark, d), "lang", "doc_id")
    model = cl.train_classifier(split.where(~F.col("is_test")), "lang", "text")
    scored = cl.predict(split.where("is_test"), {"lang": model})
    return cl.classification_report(scored, "lang", "predicted_lang")


def _labelled(spark, d):
    """Documents with three targets, under the names of the register."""
    labels = src.table(spark, d, "labels")
    return _docs(spark, d).join(labels, "doc_id").select(
        "doc_id", F.col("text").alias("complaint_text"), F.col("lang").alias("category"),
        F.when(F.col("quality") == 1, "Neutral").otherwise("Angry").alias("sentiment"),
        F.when(F.col("toxic") == 1, "Critical").otherwise("Low").alias("severity"))


_SAVED: dict[tuple[str, str], str] = {}


def models(spark, d):
    """Three models over one set of features (all words, plain counts: the second recipe),
    trained once per session and table folder, saved, and loaded from there."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _SAVED:
        path = scratch_path(spark, "models")
        save_models(cl.train_models(_labelled(spark, d), C=1.0, balanced=False, stop_words=[],
                                    sublinear=False), path)
        _SAVED[key] = path
    return load_models(_SAVED[key], cl.TARGETS)


@query()
def classify_register(spark, d):
    """Three predicted labels for every document."""
    docs = _docs(spark, d).select("doc_id", F.col("text").alias("complaint_text"))
    return cl.classify_register(docs, models(spark, d)).drop("complaint_text")


@query()
def predict_with_confidence(spark, d):
    """Labels and confidences for every conversation turn."""
    turns = src.table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("text").alias("complaint_text"))
    return cl.confidence_text(cl.predict(turns, models(spark, d))).drop("complaint_text")


@query()
def encode_documents(spark, d):
    """Hashed TF-IDF vectors of all documents."""
    docs = _docs(spark, d)
    encoder = encode.fit_encoder(docs, "text", 128)
    return encode.encode_text(docs, encoder, "text", "doc_id").select(
        "doc_id", F.size("embedding").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length"))
