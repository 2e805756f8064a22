"""Neighbour search against brute force, with copies and near copies in bulk."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewell.operators import similarity as sim
from casewell.operators import vectors as vec
from casewell.plans import q_similarity

SCHEMA = "id long, embedding array<float>"


def frame(spark, matrix, start=0):
    return spark.createDataFrame(
        [(start + i, [float(x) for x in row]) for i, row in enumerate(matrix)], SCHEMA)


def brute(queries, base, k, min_sim=None, exclude_self=True):
    """Sets of (query, neighbour, rank) from plain matrices keyed by id."""
    def unit(rows):
        m = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    base = sorted(base)
    sims = np.round(unit(queries) @ unit(base).T, 10)
    ids = [b[0] for b in base]
    out = set()
    for i, (qid, _) in enumerate(queries):
        order = sorted((j for j in range(len(ids)) if not (exclude_self and ids[j] == qid)),
                       key=lambda j: (-sims[i, j], ids[j]))
        for rank, j in enumerate(order[:k], 1):
            if min_sim is None or sims[i, j] >= min_sim:
                out.add((qid, ids[j], rank))
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    """A third exact copies of one vector, a third a tight cloud around it, the rest spread."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    cloud = centre + 0.05 * rng.standard_normal((200, 16))
    spread = rng.standard_normal((200, 16))
    m = np.vstack([np.tile(centre, (200, 1)), cloud, spread, np.zeros((1, 16))])
    m = m[rng.permutation(len(m))]
    return frame(spark, m).cache()


FORMS = {"default": {}, "small pieces": {"block_rows": 40}}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("min_sim", [None, 0.6])
def test_exact_search(spark, skewed, form, min_sim):
    rows = [(r.id, r.embedding) for r in skewed.collect()]
    got = vec.knn(skewed, skewed, 4, min_sim, **FORMS[form]).collect()
    assert {(r.query_id, r.neighbour_id, r.rank) for r in got} == brute(rows, rows, 4, min_sim)


@pytest.mark.parametrize("form", FORMS)
def test_two_tables(spark, skewed, form):
    queries = skewed.where("id % 7 = 0").select((F.col("id") + 5000).alias("id"), "embedding")
    q = [(r.id, r.embedding) for r in queries.collect()]
    b = [(r.id, r.embedding) for r in skewed.collect()]
    got = vec.knn(queries, skewed, 3, exclude_self=False, **FORMS[form]).collect()
    assert {(r.query_id, r.neighbour_id, r.rank) for r in got} == brute(q, b, 3, None, False)


def test_hashed_search_finds_true_pairs_only(spark, skewed):
    exact = {(r.query_id, r.neighbour_id): r.similarity
             for r in vec.knn(skewed, skewed, 700, 0.6).collect()}
    got = vec.knn_lsh(skewed, skewed, 4, 0.6, tables=6, bits=3, block_rows=40).collect()
    assert got and all((r.query_id, r.neighbour_id) in exact for r in got)
    assert all(abs(exact[r.query_id, r.neighbour_id] - r.similarity) < 1e-9 for r in got)
    best = {(r.query_id, r.neighbour_id) for r in vec.knn(skewed, skewed, 4, 0.6).collect()}
    found = {(r.query_id, r.neighbour_id) for r in got}
    assert len(best & found) / len(best) > 0.9


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_hashed_query_finds_nine_of_ten_neighbours(spark, sf):
    d = f"/root/testdata/sf{sf}"
    vectors = q_similarity._vectors(spark, d)
    best = {(r.query_id, r.neighbour_id)
            for r in vec.knn(vectors, vectors, 5, q_similarity.LOW).collect()}
    found = {(r.query_id, r.neighbour_id) for r in q_similarity.knn_hashed(spark, d).collect()}
    some = {p for p in best if p[0] % 50 == 0}
    print("recall", sf, len(best & found), len(best), len(some & found), len(some))
    assert len(best & found) >= 0.9 * len(best) and len(some & found) >= 0.9 * len(some) > 0


def test_fewer_rows_than_k(spark):
    df = frame(spark, [[1, 0], [0, 1], [1, 1]])
    for form in FORMS.values():
        assert vec.knn(df, df, 9, **form).count() == 6
    assert vec.knn(df, df.limit(0), 3).count() == 0


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


@pytest.fixture(scope="module")
def angles(spark):
    return frame(spark, [at(0), at(10), at(10), at(60)])  # p q r s = 0 1 2 3


def test_pairs_by_hand(angles):
    pairs = {(r.id_1, r.id_2) for r in sim.duplicate_pairs(angles, 3, 0.70).collect()}
    assert pairs == {(0, 1), (0, 2)}
    offline = {(r.id_1, r.id_2) for r in sim.duplicate_pairs(angles, 3, 0.70, None).collect()}
    assert offline == {(0, 1), (0, 2), (1, 2)}


def test_pair_is_oriented_by_first_finder(spark):
    near = spark.createDataFrame([(5, 2, 0.9), (7, 1, 0.8), (1, 7, 0.8)],
                                 "query_id long, neighbour_id long, similarity double")
    got = {(r.id_1, r.id_2) for r in sim.distinct_pairs(near).collect()}
    assert got == {(5, 2), (1, 7)}


def test_similar_drops_copies_repeats_and_own_id(spark, angles):
    texts = spark.createDataFrame(
        [(0, "A", "same beginning"), (1, "B", "other"), (2, "C", "  OTHER"), (3, "D", "far")],
        "id long, complaint_id string, complaint_text string")
    queries = frame(spark, [at(5)], 0).withColumn("own", F.lit(0).cast("long"))
    got = sim.similar(queries, angles, texts, 3, 0.5, exclude_id="own").orderBy("rank").collect()
    assert [(r.complaint_id, r.rank) for r in got] == [("B", 1), ("D", 2)]


def test_duplicate_found_is_strict(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    s = spark.createDataFrame([(1, 0.88), (2, 0.881)], "query_id long, similarity double")
    got = {r.query_id: r.duplicate_found for r in sim.duplicate_found(q, s).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_exact_duplicates(spark):
    df = spark.createDataFrame([("a", "Hello "), ("b", "hello"), ("c", "x"), ("d", None)],
                               "complaint_id string, complaint_text string")
    got = {tuple(r) for r in sim.exact_duplicates(df).collect()}
    assert got == {("a", "a", 2), ("b", "a", 2)}


@pytest.mark.parametrize("min_sim", [None, 0.3])
def test_packs_are_exact_and_a_query_goes_to_each_once(spark, monkeypatch, min_sim):
    """Vectors without structure reach every group; they are sent to packs of groups only."""
    df = frame(spark, np.random.default_rng(5).standard_normal((600, 8)))
    sent, compare = [], vec._compare
    monkeypatch.setattr(vec, "_compare", lambda q, *a: sent.append(
        q.agg(F.sum(F.size("groups"))).first()[0]) or compare(q, *a))
    stored = [(r.id, r.embedding) for r in df.collect()]
    got = vec.knn(df, df, 4, min_sim, block_rows=20, pack_rows=150).collect()
    assert {(r.query_id, r.neighbour_id, r.rank) for r in got} == brute(stored, stored, 4, min_sim)
    assert sum(sent) <= 600 * 6  # 600 rows in packs of 150 and a group's rest
    sent.clear()
    vec.knn(df, df, 4, min_sim, block_rows=20)
    assert sum(sent) == 600  # one pack by default


def test_pack_rows_are_bounded_by_memory():
    assert vec._pack_rows(10**9, 64) * 64 <= vec.PACK_CELLS
    assert vec._pack_rows(1000, 64) == vec.BLOCK_ROWS and vec._pack_rows(10, 10**8) == 1


def test_blocks_give_the_best_in_double_precision(monkeypatch):
    """Against all pairs: several blocks, floors, ties and values that single precision mixes up."""
    monkeypatch.setattr(vec, "STEP_BASE", 16)
    monkeypatch.setattr(vec, "STEP_QUERY", 8)
    rng = np.random.default_rng(9)
    q, b = rng.standard_normal((30, 6)).astype("f4"), rng.standard_normal((90, 6)).astype("f4")
    b[40:60] = b[3] + rng.standard_normal((20, 6)).astype("f4") * 1e-4
    b[70] = 2 * b[5]
    q[:4] = b[3:7]
    floor = np.where(np.arange(30) % 3 == 0, 0.2, -2.0)
    sims = vec._unit_rows(q) @ vec._unit_rows(b).T
    row, col, value = vec._best(q, b, 5, floor)
    for i in range(30):
        want = [x for x in np.lexsort((np.arange(90), -np.round(sims[i], 13)))[:5]
                if sims[i, x] >= floor[i]]
        assert list(col[row == i]) == want
        assert np.abs(value[row == i] - sims[i, want]).max(initial=0) < 1e-12


def test_a_threshold_does_not_list_k_rows_of_every_pack(spark, monkeypatch):
    """The k-th best of the first pack is the floor in the others, also beside a low threshold."""
    turn = np.random.default_rng(8).random(600) * math.pi / 2
    df = frame(spark, np.stack([np.cos(turn), np.sin(turn)], axis=1))
    found, compare = [], vec._compare
    monkeypatch.setattr(vec, "_compare", lambda *a: found.append(compare(*a)) or found[-1])
    unit = vec._unit_rows(np.array([r.embedding for r in df.orderBy("id").collect()]))
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    got = vec.knn(df, df, 4, -1.0, block_rows=600, pack_rows=30).orderBy("query_id", "rank")
    assert np.allclose([r.similarity for r in got.collect()], -np.sort(-sims)[:, :4].ravel(), 0, 1e-12)
    assert sum(f.count() for f in found) < 600 * 5 * 6  # of some 20 packs


def test_large_tables_send_a_pack_to_fewer_pieces_of_queries(spark, monkeypatch):
    df = frame(spark, np.random.default_rng(7).standard_normal((600, 4)))
    rows, compare = [], vec._compare
    monkeypatch.setattr(vec, "_compare", lambda *a: rows.append(a[3:]) or compare(*a))
    vec.knn(df, df, 4, 0.5, block_rows=20, pack_rows=10).count()
    assert rows == [(10, 40), (10, 40)]
