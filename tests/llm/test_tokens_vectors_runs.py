"""Rank-queue BPE, whitening and periodic runs against the library, plain numpy and brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from casewell import llm
from casewell.llm import byte_bpe, periodic_runs, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, ids string, runs string, decoded string, n bigint"
ODD = [(1, "same text here", "x", "y", "z", 1), (2, "same text here", None, None, None, None),
       (2, "same text here", None, None, None, None), (None, None, None, None, None, None),
       (5, "", "", "", "", 0), (6, " \n ", "", "", "", 0), (7, "word " * 30_000, "", "", "", 0),
       (8, "日本語 😀  x  y  \n\n z", "", "", "", 0), (9, "a" * 50_000, "", "", "", 0),
       (10, " a  b \n c\t d ", "", "", "", 0), (11, "don't we'll 12345 x=1;\r\n\r\n  q", "", "", "", 0)]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=byte_bpe.read_ranks(RANKS))


def random_texts(count, seed):
    pick = random.Random(seed)
    kinds = [lambda: pick.randrange(32, 127), lambda: pick.randrange(0x300, 0x3000),
             lambda: pick.randrange(0x110000), lambda: pick.choice([32, 32, 10, 9, 0xA0, 0x2003]),
             lambda: pick.randrange(97, 123), lambda: pick.randrange(97, 100)]
    texts = ["".join(chr(pick.choice(kinds)()) for _ in range(pick.randrange(80)))
             for _ in range(count)]
    return ["".join(c for c in t if not 0xD800 <= ord(c) < 0xE000) for t in texts]


def test_bpe_gives_the_ids_of_the_library(library):
    texts = random_texts(3000, 5) + [r[1] or "" for r in ODD] + [
        "ab" * 20_000, "".join(random.Random(1).choice("abcde") for _ in range(30_000)),
        "a՘b \U000323B5x 1\U00011DE0"]  # letters and digits newer than the library
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    assert encoder.documents(pa.array(texts)).to_pylist() == [
        library.encode_ordinary(t) for t in texts]


def test_both_queues_merge_alike_whatever_the_ranks():
    pick = random.Random(2)
    for _ in range(150):  # ranks in any order: a later merge may have a smaller rank
        tokens = {bytes([b]) for b in b"abc"}
        for _ in range(pick.randrange(25)):
            a, b = pick.choice(sorted(tokens)), pick.choice(sorted(tokens))
            if len(a + b) < 9:
                tokens.add(a + b)
        order = sorted(tokens - {b"a", b"b", b"c"})
        pick.shuffle(order)
        ranks = {t: k for k, t in enumerate([b"a", b"b", b"c", *order])}
        words = byte_bpe.Vocabulary(ranks)
        pieces = [bytes(pick.choice(b"abc") for _ in range(pick.randrange(1, 40)))
                  for _ in range(30)]
        pieces = [p for p in pieces if p not in ranks]
        if not pieces:
            continue
        many = [np.frombuffer(x, "<i4").tolist() for x in words.merge_many(pieces)]
        assert many == [words.merge(p) for p in pieces] == [plain_merge(p, ranks) for p in pieces]


def plain_merge(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:]))
                 if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


def test_memory_starts_anew_without_loss(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 50)
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 500)
    texts = random_texts(300, 8)
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    got = [ids for block in byte_bpe._blocks(pa.array(texts))
           for ids in encoder.documents(block).to_pylist()]
    assert got == [library.encode_ordinary(t) for t in texts] and len(encoder.memo) <= 50


def test_bpe_odd_rows_and_round_trip(spark, library):
    odd = spark.createDataFrame(ODD, DOCS)
    ids = byte_bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decode_ids(ids, RANKS).collect()
    want = {r[0]: r[1] or "" for r in ODD}
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    for r in rows:
        assert r.ids == library.encode_ordinary(want[r.doc_id])
        assert bytes(r.decoded) == want[r.doc_id].encode()
    none = byte_bpe.encode_documents(odd.limit(0), RANKS, public_tokenizers.PATTERN)
    assert byte_bpe.decode_ids(none, RANKS).collect() == []


def test_decoding_of_lists_that_no_text_has(spark):
    lists = [(1, None), (2, []), (3, [60_000]), (4, [-1]), (5, [None]), (6, [0, 1])]
    rows = byte_bpe.decode_ids(spark.createDataFrame(lists, "doc_id int, ids array<int>"), RANKS)
    found = {r.doc_id: r.decoded for r in rows.collect()}
    tokens = {i: t for t, i in byte_bpe.read_ranks(RANKS).items()}
    assert [found[k] for k in (1, 3, 4, 5)] == [None] * 4
    assert found[2] == b"" and bytes(found[6]) == tokens[0] + tokens[1]


def test_bpe_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = llm.queries()["op11_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("spectrum", [
    [5, 4, 3, 2, 1, .5], [3] * 20 + [1] * 20, [0] * 6, [1, 0, 0, 0], [7], [2, 2],
    list(3 + 1e-10 * np.arange(15)) + [1] * 10, list(np.arange(30.) ** 6)])
def test_leading_pairs(spectrum):
    n = len(spectrum)
    basis, _ = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    matrix = (basis * spectrum) @ basis.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_pairs(matrix, 8)
    size = max(np.abs(spectrum).max(), 1e-300)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:8], atol=1e-13 * size, rtol=0)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def whitened(spark, rows, kind="vec_id bigint, embedding array<float>", **options):
    return whitening.whiten(spark.createDataFrame(rows, kind), **options)


def test_whitening_odd_rows(spark):
    random_ = np.random.default_rng(4)
    good = [(k, random_.standard_normal(5).tolist()) for k in range(40)]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5),
           (103, [1.0, float("-inf"), 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, [])]
    twice = [good[0], (None, good[1][1])]
    found = whitened(spark, good + odd + twice).collect()
    assert Counter(r.vec_id for r in found) == Counter(k for k, _ in good + twice)
    assert {r.n for r in found} == {42} and all(len(r.whitened) == 5 for r in found)
    assert found[0].identity_error < 1e-10 and abs(sum(found[0].explained) - 1) < 1e-12
    x = np.floor(1024 * np.array([v for _, v in good + twice], np.float32).astype(float)) + 100000
    away = {k: int(d) for (k, _), d in zip(
        good, ((42 * x - x.sum(0)) ** 2).sum(1), strict=False)}
    assert all(int(r.deviation) == away[r.vec_id] for r in found if r.vec_id is not None)


def test_whitening_of_nothing_and_of_equal_vectors(spark):
    assert whitened(spark, []).collect() == []
    assert whitened(spark, [(1, None)]).collect() == []
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        found = whitened(spark, rows).collect()
        assert [(r.whitened, int(r.deviation), r.identity_error) for r in found] == [
            ([], 0, 0.0)] * len(rows)
        assert whitening.whitened_rows(whitened(spark, rows)).collect() == []


def test_whitening_of_huge_entries_and_clashing_columns(spark):
    rows = [(1, [1e300, 0.0], 5), (2, [-1e300, 1.0], 6), (3, [0.5, 2.0], 7)]
    found = whitened(spark, rows, "vec_id int, embedding array<double>, n int").collect()
    assert len(found) == 3 and {r.n for r in found} == {3}
    assert all(r.deviation is None or r.deviation > 0 for r in found)


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(1024 * np.stack(given.embedding).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    want = y @ basis / np.sqrt(values)
    rows = llm.queries()["op12_whitening"](spark, sf).toPandas()
    assert len(rows) == 8 * n and set(rows.n) == {n}
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    one = rows[rows.component == 1].sort_values("vec_id")
    assert one.deviation.tolist() == ((n * x - sums) ** 2).sum(1).tolist()
    share = rows.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, values / (y * y).sum() * n, rtol=1e-9)
    assert rows.identity_error.max() < 1e-10


def plain_runs(words, least, power):
    found = {}
    for p in range(1, len(words) // power + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, power * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


@pytest.mark.parametrize("top", [4, 32])
def test_runs_against_brute_force(top, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TOP_SYMBOLS", top)
    pick = random.Random(top)
    for _ in range(150):
        texts = []
        for _ in range(pick.randrange(1, 10)):
            n, kinds = pick.choice([0, 1, 5, 30, 100, 250]), pick.choice([1, 2, 2, 3, 5, 50])
            w = [pick.randrange(kinds) for _ in range(n)]
            if n and pick.random() < .7:
                a = pick.randrange(n)
                p = 1 + pick.randrange(max(1, (n - a) // 3))
                w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
            if n > 50 and pick.random() < .3:
                w[25:25] = [7] * pick.randrange(20, 30)
            texts.append(np.array(w, np.int32))
        least, power = pick.choice([(24, 3), (6, 2), (4, 2), (10, 3), (1, 2)])
        found = periodic_runs.find_runs(texts, least, power)
        for w, runs in zip(texts, found, strict=True):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(w.tolist(), least, power)


def test_runs_of_long_documents(monkeypatch):
    """Beyond the remembered grids, some periods at a time."""
    monkeypatch.setattr(periodic_runs, "BLOCK_POINTS", 20_000)
    pick = np.random.default_rng(1)
    w = pick.integers(0, 40_000, 90_000)
    w[1000:4000] = np.resize(w[1000:1700], 3000)
    w[50_000:90_000] = np.resize(w[50_000:62_000], 40_000)
    runs = periodic_runs.find_runs([w[:10], w.astype(np.int32)])[1].tolist()
    assert [(s, p) for s, n, p in runs] == [(1000, 700), (50_000, 12_000)]
    assert [n for s, n, p in runs] == [3000, 40_000]


def test_runs_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    rows = periodic_runs.periodic_runs(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7].collapsed == "word" and [tuple(r) for r in by_id[7].runs] == [(0, 30_000, 1)]
    assert (by_id[None].n_words, by_id[None].runs, by_id[None].collapsed) == (0, [], "")
    assert by_id[8].collapsed == "日本語 😀 x  y  z" and by_id[8].n_words == 5
    assert periodic_runs.periodic_runs(odd.limit(0)).collect() == []


def test_runs_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = llm.queries()["op13_periodic_runs"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    some = 0
    for r in rows:
        words = texts[r.doc_id].encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words, 24, 3)
        dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
        left = b" ".join(w for k, w in enumerate(words) if k not in dropped)
        assert r.n_runs == len(runs)
        assert r.collapsed_sha256 == hashlib.sha256(left).hexdigest()
        assert r.runs_sha256 == hashlib.sha256(
            "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        best = max(runs, key=lambda t: (Fraction(t[1], t[2]), -t[0], -t[2]), default=None)
        if best is None:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
        else:
            some += 1
            assert (r.start, r.length, r.period) == best
            assert r.exponent_milli == 1000 * best[1] // best[2]
    assert some
