"""The thin queries over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F  # noqa: F401

from . import (
    bag_minhash, byte_bpe, exact_dedup, html_text, language, packing,
    periodic_runs, pii, quality, sentencepiece_viterbi, sharding, warc, whitening,
)
from .common import NON_SPACE, let, scratch_path, table, text_of
from .registry import query


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op1_exact_dedup(spark, sf_dir):
    """Groups of equal texts by Grace hashing."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op8_bag_minhash(spark, sf_dir):
    """Classes of near duplicates by BagMinHash."""
    return bag_minhash.near_classes(table(spark, sf_dir, "documents"))


@query()
def op9_packing(spark, sf_dir):
    """Pieces of all documents in sequences of several context sizes."""
    import public_tokenizers

    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


@query()
def op2_language(spark, sf_dir):
    """Language of each document by cross-parsing."""
    return language.predict_language(table(spark, sf_dir, "documents"))


def _shard_sql() -> str:
    """Leaf of each document: the shortest prefix of its key whose bytes fit."""
    deepest = 24
    keyed = ("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, "
             "lpad(bin(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT), 60, '0') "
             "AS k FROM documents")
    levels = f"SELECT doc_id, n_bytes, d AS depth, k[:d] AS shard FROM k, range(0, {deepest}) r(d)"
    return f"""
WITH k AS ({keyed}), l AS ({levels}),
s AS (SELECT *, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows
      FROM l WINDOW w AS (PARTITION BY depth, shard))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(depth AS BIGINT) AS depth, shard,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
FROM s WHERE shard_bytes <= {sharding.SHARD_BYTES} OR shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


@query(_shard_sql())
def op3_sharding(spark, sf_dir):
    """Shard of each document by extendible hashing."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query()
def op6_sentencepiece(spark, sf_dir):
    """Piece ids of each document, with the round trip."""
    import public_tokenizers

    return sentencepiece_viterbi.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op7_quality(spark, sf_dir):
    """Counts and verdict of each document."""
    return quality.quality(table(spark, sf_dir, "documents"))


@query()
def op4_pii(spark, sf_dir):
    """Personal data in each document."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query()
def op5_html_text(spark, sf_dir):
    """Main text of each page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query("""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j:
           CAST(substr(bits, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER)
           * CAST(pow(2, 4 - j) AS INTEGER)))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p
""")
def op10_warc(spark, sf_dir):
    """Records of the archives of all pages, as read back."""
    folder = scratch_path(spark, "warc")
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), folder, roll_bytes=4 << 20)
    return warc.read_warc(manifest, folder).drop("file")


@query()
def op11_byte_bpe(spark, sf_dir):
    """Token ids of each document by the rank queue, and the bytes they stand for."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), path,
                                        public_tokenizers.PATTERN)
    return byte_bpe.decode_ids(encoded, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op12_whitening(spark, sf_dir):
    """Whitened components of each vector."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return whitening.whitened_rows(found).withColumn(
        "deviation", F.col("deviation").try_cast("bigint"))


def _with_planted_runs(docs):
    """Documents whose crc32 of the id ends with 0 repeat a part of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")),
                                lambda s: F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: words[F.when(i < s.a, i).otherwise(s.a + (i - s.a) % s.p)])), " ")

    words = F.regexp_extract_all(text_of(), F.lit(NON_SPACE + "+"), F.lit(0))
    repeated = let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(""))
    return docs.select("doc_id", F.when(h % 10 == 0, repeated).otherwise(text_of()).alias("text"))


@query()
def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of words of each document, some of them with planted ones."""
    found = periodic_runs.periodic_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),"
                  " (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, "
                   "'\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length",
        "best.period", F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
