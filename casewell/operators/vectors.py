"""Exact and hashed nearest neighbours over unit vectors, as Spark joins of bounded blocks.

Work is shared out in these steps:

1.  Equal vectors are collapsed to one, with the lowest k+1 ids of each (a limit per group
    that is applied before the shuffle). A vector that a third of the rows share is compared
    once; its rows get their lists back by a join at the end.
2.  Base vectors are put into groups: nearest pivot, then rings of the angle to that pivot.
    A query visits a group only if the triangle inequality on angles lets a member reach the
    query's floor: the k-th best value found in one first pack, or the similarity threshold if
    that is higher. Skipped groups hold no result, so the outcome stays exact.
3.  Groups are put into packs of neighbours with some `PACK_CELLS` numbers, the unit of the
    shuffle: a query is sent once to a pack that holds a group it visits, not once to each small
    group. Both sides of a pack are cut into pieces whatever the size of the group: of a pack's
    size on average, and of up to `QUERY_PACKS` packs of queries where there are many packs, since
    the base is sent once to each piece of queries. One task compares one piece with one piece by
    matrix products and keeps the best k+1 per query; pairs are never listed.
4.  The short lists are merged by a window with a limit.

Tables of every size take this one way."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BLOCK_ROWS = 16_384
MAX_PIVOTS = 1_024
RINGS = 64
MAX_HASH_GROUPS = 1 << 19
CELLS_PER_STEP = 4 << 20  # entries of one matrix of angles, 32 MB
STEP_QUERY, STEP_BASE = 512, 2048  # rows of both sides that are compared at once
SCREEN = 1e-4  # far above the error of a product of unit vectors in single precision
PACK_CELLS = 16 << 20  # numbers in the base vectors of a pack at most, 64 MB as floats
QUERY_PACKS = 4  # packs of queries that are sent to a pack of the base at once, at most
FEWEST_PACKS = 16  # so that a table of medium size is spread over many tasks
ANGLE_SLACK = 1e-7


# -- numpy kernels, run inside tasks ------------------------------------------

def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    norm[norm == 0] = 1.0
    return m / norm


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix of floats."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    norm[norm == 0] = 1.0
    return m / norm


def _best(q: np.ndarray, b: np.ndarray, k: int, floor: np.ndarray):
    """(row of q, row of b, similarity) of the k best per row of q at or above its floor; among
    equal values the lower row of b comes first.

    Blocks are screened in single precision, those within its error of the floor are computed in
    double precision. The floor of a row rises to its k-th best, so that few are computed."""
    base = np.concatenate([_unit_rows(b[at:at + STEP_BASE]).astype(np.float32)
                           for at in range(0, len(b), STEP_BASE)])
    out = []
    for lo in range(0, len(q), STEP_QUERY):
        own = _unit_rows(q[lo:lo + STEP_QUERY])
        single, low = own.astype(np.float32), floor[lo:lo + STEP_QUERY].astype(np.float64)
        r, c, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(b), STEP_BASE):
            sims = single @ base[at:at + STEP_BASE].T
            hit = sims >= (low - SCREEN).astype(np.float32)[:, None]
            if sims.shape[1] > k and np.count_nonzero(hit) > 4 * k * len(own):
                edge = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k] - 2 * SCREEN
                hit &= sims >= edge.astype(np.float32)[:, None]
            found = np.flatnonzero(hit)
            row, col = found // sims.shape[1], found % sims.shape[1] + at
            for some in range(0, len(row), 4 * STEP_QUERY):
                x, y = row[some:some + 4 * STEP_QUERY], col[some:some + 4 * STEP_QUERY]
                value = np.einsum("ij,ij->i", own[x], _unit_rows(b[y]))
                keep = value >= low[x]
                r, c, v = (np.concatenate(z) for z in (
                    (r, x[keep]), (c, y[keep]), (v, value[keep])))
            if len(r) > 2 * k * len(own) or at + STEP_BASE >= len(b) or not at:
                order = np.lexsort((c, -v, r))
                r, c, v = r[order], c[order], v[order]
                place = np.arange(r.size) - np.searchsorted(r, r, side="left")
                last = place == k - 1
                low[r[last]] = np.maximum(low[r[last]], v[last])
                r, c, v = r[place < k], c[place < k], v[place < k]
        out.append((r + lo, c, v))
    return [np.concatenate(x) for x in zip(*out)]


def _steps(n_query: int, n_base: int):
    step = max(1, CELLS_PER_STEP // max(1, n_base))
    for lo in range(0, n_query, step):
        yield slice(lo, min(n_query, lo + step))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


# -- helpers -------------------------------------------------------------------

def l2_normalize(vector: Column | str) -> Column:
    """Vector divided by its length, as doubles; a zero vector stays as it is."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector,
                    lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def _keyed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, h1, h2): two independent 64-bit hashes name the vector."""
    v = F.col(vec_col).cast("array<float>")
    return df.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"), v.alias("vec"),
        F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"),
    )


def _collapsed(keyed: DataFrame, n_ids: int) -> DataFrame:
    """One row per distinct vector with its lowest `n_ids` ids."""
    order = Window.partitionBy("h1", "h2").orderBy("id")
    lowest = keyed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n_ids)
    return lowest.groupBy("h1", "h2").agg(
        F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")
    )


def _shape(df: DataFrame) -> tuple[int, int]:
    n, dim = df.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    return int(n or 0), int(dim or 0)


# -- public --------------------------------------------------------------------

def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    min_sim: float | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    exclude_self: bool = True,
    block_rows: int = BLOCK_ROWS,
    pack_rows: int | None = None,
) -> DataFrame:
    """Exact k nearest base rows per query row by cosine: (query_id, neighbour_id,
    similarity, rank). With `min_sim`, those of the k that reach it. Ties go to the lower id;
    a base row with the query's own id is left out if `exclude_self`.

    `block_rows` is the number of base rows to a pivot, `pack_rows` that of a unit of the shuffle
    (by default as many as memory and the number of tasks allow).

    The vectors are read more than once (size, pivots, groups): store them first, or pass a
    materialised frame, when an encoder computes them."""
    same = queries is base
    b = _keyed(base, id_col, vec_col)
    q = b if same else _keyed(queries, id_col, vec_col)
    n, dim = _shape(b)
    if not n:  # nothing to find
        return q.select(F.col("id").alias("query_id"), *[
            F.lit(None).cast(t).alias(c) for c, t in (
                ("neighbour_id", b.schema["id"].dataType), ("similarity", "double"),
                ("rank", "int"))]).limit(0)
    return _knn_blocked(q, b, same, n, k, min_sim, exclude_self, block_rows,
                        pack_rows or _pack_rows(n, dim))


def _pack_rows(n: int, dim: int) -> int:
    """Base rows of a pack: bounded by memory, at least BLOCK_ROWS where memory allows it, and
    else a share of the table, since each query is sent to at most every pack."""
    most = max(1, PACK_CELLS // max(1, dim))
    return min(most, max(BLOCK_ROWS, n // FEWEST_PACKS))


def knn_lsh(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    min_sim: float | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    exclude_self: bool = True,
    tables: int = 8,
    bits: int = 8,
    seed: int = 7,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate form: a query is compared only with base rows that share one of `tables`
    random-plane signatures of `bits` bits. Every pair found is a true pair with its exact
    similarity; pairs may be missing. Large buckets are cut into pieces like any group.

    `tables` and `bits` are fixed whatever the size of the base, so that recall does not change
    as it grows: a pair at angle a is met with probability 1 - (1 - (1 - a / pi)^bits)^tables. They
    have to fit the similarity that is looked for: the defaults meet 0.93 of the pairs at 0.9,
    0.75 of those at 0.8 and 0.18 at 0.4, where 24 tables of 4 bits meet 0.98."""
    if tables << bits > MAX_HASH_GROUPS:
        raise ValueError(f"tables * 2^bits is more than {MAX_HASH_GROUPS} groups")
    same = queries is base
    b = _keyed(base, id_col, vec_col)
    q = b if same else _keyed(queries, id_col, vec_col)
    _, dim = _shape(b)
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    weights = (1 << np.arange(bits)).astype(np.int64)

    def signatures(batches):
        for pdf in batches:
            if len(pdf):
                side = (_unit(pdf["vec"]) @ planes > 0).reshape(len(pdf), tables, bits)
                code = (side * weights).sum(axis=2) + (np.arange(tables) << bits)
                pdf["groups"] = [row.astype(np.int32) for row in code]
                yield pdf

    rows_b = _collapsed(b, k + 1)
    hashed_b = materialize(rows_b.mapInPandas(signatures, _with(rows_b, "groups array<int>")))
    if same:
        hashed_q = hashed_b.drop("ids")
    else:
        rows_q = q.dropDuplicates(["h1", "h2"]).select("h1", "h2", "vec")
        hashed_q = materialize(rows_q.mapInPandas(signatures, _with(rows_q, "groups array<int>")))
    floor = -2.0 if min_sim is None else float(min_sim)
    hits = _compare(hashed_q.withColumn("floor", F.lit(floor)), hashed_b, k + 1, block_rows)
    return _merge(hits, q, k, exclude_self, repeated=True)


# -- exact search -------------------------------------------------------------

def _with(df: DataFrame, *fields: str) -> T.StructType:
    extra = T._parse_datatype_string(", ".join(fields))
    return T.StructType(df.schema.fields + extra.fields)


def _knn_blocked(q, b, same, n, k, min_sim, exclude_self, block_rows, pack_rows) -> DataFrame:
    spark = q.sparkSession
    n_pivots = int(max(1, min(MAX_PIVOTS, n // block_rows)))
    pivots = _unit(b.orderBy("h1", "h2", "id").limit(n_pivots).toPandas()["vec"])
    pivots = np.unique(pivots, axis=0)
    width = math.pi / RINGS
    shared_pivots = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        p = shared_pivots.value
        for pdf in batches:
            if len(pdf):
                theta = _angles(_unit(pdf["vec"]), p)
                cell = theta.argmin(axis=1)
                own = theta[np.arange(len(pdf)), cell]
                ring = np.minimum(RINGS - 1, (own / width).astype(np.int64))
                pdf["g"] = (cell * RINGS + ring).astype(np.int32)
                pdf["theta"] = own
                yield pdf

    rows_b = _collapsed(b, k + 1)
    placed = materialize(rows_b.mapInPandas(assign, _with(rows_b, "g int", "theta double")))
    # at most MAX_PIVOTS * RINGS rows, whatever the number of vectors
    table = (
        placed.groupBy("g")
        .agg(F.min("theta").alias("lo"), F.max("theta").alias("hi"),
             F.count(F.lit(1)).alias("n"))
        .toPandas().sort_values("g", ignore_index=True)
    )
    # neighbours in the order of pivot and ring share a pack until it is full
    filled = (table["n"].cumsum() - table["n"]) // pack_rows
    table["pack"] = (filled != filled.shift()).cumsum() - 1
    shared_table = spark.sparkContext.broadcast(
        tuple(table[c].to_numpy() for c in ("g", "lo", "hi", "n", "pack"))
    )
    packs = spark.createDataFrame(
        [(int(g), [int(p)]) for g, p in zip(table["g"], table["pack"])],
        "g int, groups array<int>")
    packed = placed.drop("theta").join(F.broadcast(packs), "g").drop("g")

    def reachable(batches):
        """Packs of the groups that may hold a vector within the angle of the query's floor."""
        p = shared_pivots.value
        g, lo, hi, _, pack = shared_table.value
        cell, starts = g // RINGS, np.searchsorted(pack, np.arange(pack[-1] + 1))
        for pdf in batches:
            if not len(pdf):
                continue
            theta = _angles(_unit(pdf["vec"]), p)
            radius = np.arccos(np.clip(pdf["floor"].to_numpy(), -1.0, 1.0)) + ANGLE_SLACK
            done = pdf["home"].to_numpy()
            found = []
            for part in _steps(len(pdf), g.size):
                t = theta[part][:, cell]
                r = radius[part][:, None]
                ok = np.logical_or.reduceat((t - hi <= r) & (lo - t <= r), starts, axis=1)
                ok &= np.arange(starts.size) != done[part][:, None]
                found += [np.nonzero(row)[0].astype(np.int32) for row in ok]
            pdf["groups"] = found
            yield pdf

    def home(batches):
        """The pack of the group that may hold the nearest vector, of equal ones that with the nearest
        pivot, among those with k+1 or more."""
        p = shared_pivots.value
        g, lo, hi, count, pack = shared_table.value
        full = np.nonzero(count > k)[0]
        for pdf in batches:
            if not len(pdf):
                continue
            theta = _angles(_unit(pdf["vec"]), p)
            picks = []
            for part in _steps(len(pdf), max(1, full.size)):
                if full.size:
                    t = theta[part][:, g[full] // RINGS]
                    gap = np.maximum(np.maximum(t - hi[full], lo[full] - t), 0) + t / 64
                    picks += [np.array([x], dtype=np.int32)
                              for x in pack[full][gap.argmin(axis=1)]]
                else:
                    picks += [np.array([], dtype=np.int32)] * (part.stop - part.start)
            pdf["groups"] = picks
            yield pdf

    if same:
        rows_q = placed.select("h1", "h2", "vec")
    else:
        rows_q = materialize(q.dropDuplicates(["h1", "h2"]).select("h1", "h2", "vec"))
    floor = -2.0 if min_sim is None else float(min_sim)
    packs_of_queries = int(min(QUERY_PACKS, max(1, (table["pack"].max() + 1) // 6)))
    query_rows = pack_rows * packs_of_queries
    at_home = materialize(rows_q.mapInPandas(home, _with(rows_q, "groups array<int>")))
    first = materialize(_compare(
        at_home.withColumn("floor", F.lit(floor)), packed, k + 1, pack_rows, query_rows))
    start = (
        at_home.join(_kth(first, k), ["h1", "h2"], "left")
        .withColumn("floor", F.greatest(F.coalesce("floor", F.lit(floor)), F.lit(floor)))
        .withColumn("home", F.coalesce(F.try_element_at("groups", F.lit(1)), F.lit(-1)))
        .drop("groups")
    )
    visits = materialize(start.mapInPandas(reachable, _with(start, "groups array<int>")))
    hits = _compare(visits.drop("home"), packed, k + 1, pack_rows, query_rows)
    return _merge(hits.unionByName(first), q, k, exclude_self)


def _kth(hits: DataFrame, k: int) -> DataFrame:
    """Similarity of the k-th other row found so far: k+1 ids of the lists, one may be the
    query itself. Queries with fewer keep no floor."""
    ranked = hits.select("h1", "h2", "sim", F.explode("ids").alias("id")).withColumn(
        "_r", F.row_number().over(
            Window.partitionBy("h1", "h2").orderBy(F.desc("sim"), "id"))
    )
    return ranked.where(F.col("_r") <= k + 1).groupBy("h1", "h2").agg(
        F.min("sim").alias("floor"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") > k).drop("_n")


def _compare(q: DataFrame, b: DataFrame, keep: int, block_rows: int,
             query_rows: int | None = None) -> DataFrame:
    """Compare every query (h1, h2, vec, floor, groups) with every base row (h1, h2, vec, ids,
    groups) of its groups; the best `keep` per query and piece as (h1, h2, sim, ids)."""
    flat_q = q.withColumn("g", F.explode("groups")).drop("groups")
    flat_b = b.withColumn("g", F.explode("groups")).drop("groups")

    def pieces(flat: DataFrame, name: str, rows: int) -> DataFrame:
        return flat.groupBy("g").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name))

    # one row per group: bounded by MAX_PIVOTS * RINGS or MAX_HASH_GROUPS
    plan = F.broadcast(pieces(flat_q, "nq", query_rows or block_rows).join(
        pieces(flat_b, "nb", block_rows), "g"))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("h2", "h1"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    keys = ["g", "pq", "pb"]
    left = flat_q.join(plan, "g").withColumn("pq", own("nq")).withColumn("pb", every("nb"))
    right = flat_b.join(plan, "g").withColumn("pb", own("nb")).withColumn("pq", every("nq"))
    # fresh names: both sides may come from one frame
    left = left.select(*keys, "h1", "h2", F.col("vec").alias("qvec"), "floor")
    right = right.select(*[F.col(c).alias(c) for c in keys], "ids", F.col("vec").alias("bvec"))
    out = T.StructType([*T._parse_datatype_string("h1 long, h2 long, sim double").fields,
                        T.StructField("ids", b.schema["ids"].dataType)])

    def piece(qs: pa.Table, bs: pa.Table) -> pa.Table:
        row = col = np.zeros(0, np.int64)
        value = np.zeros(0)
        if qs.num_rows and bs.num_rows:
            # rows in id order: among equal similarities the lower id survives
            bs = bs.take(pc.sort_indices(pc.list_element(bs.column("ids"), 0)))
            row, col, value = _best(_rows(qs.column("qvec")), _rows(bs.column("bvec")), keep,
                                    qs.column("floor").to_numpy())
        row, col = pa.array(row), pa.array(col)
        return pa.table([qs.column("h1").take(row), qs.column("h2").take(row),
                         pa.array(value, pa.float64()), bs.column("ids").take(col)], out.names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(piece, out)


def _merge(hits: DataFrame, q: DataFrame, k: int, exclude_self: bool, repeated: bool = False
           ) -> DataFrame:
    """Short lists → the k+1 best per distinct vector → k best per query row."""
    flat = hits.select("h1", "h2", "sim", F.explode("ids").alias("nid"))
    if repeated:
        flat = flat.groupBy("h1", "h2", "nid").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("sim"), "nid")
    best = (
        flat.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.sort_array(F.collect_list(F.struct("_r", "nid", "sim"))).alias("best"))
    )
    # stored, so that both sides have a shuffle of their own and a vector that many rows share
    # can be split by the adaptive skew join
    rows = q.select("id", "h1", "h2").join(materialize(best), ["h1", "h2"])
    mine = F.col("best")
    if exclude_self:
        mine = F.filter("best", lambda x: x["nid"] != F.col("id"))
    return rows.select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(mine, 1, k)).alias("_p", "_b")
    ).select(
        "query_id", F.col("_b.nid").alias("neighbour_id"), F.col("_b.sim").alias("similarity"),
        (F.col("_p") + 1).alias("rank"),
    )
