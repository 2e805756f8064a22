"""Whitening of vectors by the leading components of their covariance.

- The vectors' integer form, their exact sums and their centred products are gathered in one pass:
  a task centres each batch on the batch's own mean before it multiplies, and moves what it holds
  to the common mean of both (pairwise update). Tasks emit one row each; a second small job moves
  these to the mean of all and adds them up by matrix entry.
- The covariance (dimension squared, within a stated bound) is reduced to tridiagonal form by
  Householder reflections; its leading eigenvalues are found by bisection on Sturm counts, its
  eigenvectors by inverse iteration, orthogonalised again within clusters of eigenvalues, and
  carried back through the reflections.
- The components are broadcast, every vector is projected in its own task. The projected rows are
  stored once, since their covariance is measured before they are returned."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Most dimensions: the covariance and its reflections are then at most 128 MB each.
DIMENSIONS = 4096
#: The integer form of an entry c is floor(SCALE * c) + SHIFT, kept within +-LIMIT.
SCALE, SHIFT, LIMIT = 1024, 100_000, 1 << 62
#: Eigenvalues closer than this share of the largest one form a cluster; those below the other
#: share of it are no components.
CLUSTER, LEAST = 1e-3, 1e-13
COMPONENTS = 8


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric matrix, falling, and their unit
    eigenvectors as columns."""
    scale = float(np.abs(matrix).max(initial=0.0)) or 1.0
    diagonal, beside, reflections = _tridiagonal(matrix / scale)
    values = _largest(diagonal, beside, min(count, len(diagonal)))
    vectors = _inverse_iteration(diagonal, beside, values)
    for k in range(len(reflections) - 1, -1, -1):  # back through the reflections
        v = reflections[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


def _tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, entries beside it, and the unit vectors of the Householder reflections."""
    a, n = matrix.copy(), len(matrix)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1:, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        part = a[k + 1:, k + 1:]
        w = part @ v
        w -= (v @ w) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ x)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def _largest(diagonal: np.ndarray, beside: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues by bisection, all at once: a Sturm count tells how many
    eigenvalues lie below a point."""
    n = len(diagonal)
    off = np.abs(np.concatenate([[0.0], beside, [0.0]]))
    reach = off[:-1] + off[1:]
    low = np.full(count, (diagonal - reach).min(initial=0.0))
    high = np.full(count, (diagonal + reach).max(initial=0.0))
    wanted = n - np.arange(count)  # so many lie below a point above the k-th largest
    squares, tiny = off[1:-1] ** 2, np.finfo(float).tiny ** 0.5
    for _ in range(110):
        middle = (low + high) / 2
        below = np.zeros(count, int)
        q = np.ones(count)
        for i in range(n):
            q = diagonal[i] - middle - (squares[i - 1] / q if i else 0.0)
            q = np.where(np.abs(q) < tiny, -tiny, q)
            below += q < 0
        up = below < wanted
        low, high = np.where(up, middle, low), np.where(up, high, middle)
        if np.all(high - low <= 2 * np.spacing(np.abs(high))):
            break
    return (low + high) / 2


def _solve(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray
           ) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; a vanishing pivot is replaced by
    a tiny one."""
    n, tiny = len(diagonal), np.finfo(float).eps
    d = (diagonal - shift).tolist()
    upper, second, lower = beside.tolist(), [0.0] * n, beside.tolist()
    x = right.tolist()
    for i in range(n - 1):
        if abs(lower[i]) > abs(d[i]):
            following = upper[i + 1] if i + 1 < n - 1 else 0.0
            factor = d[i] / lower[i]
            d[i], upper[i], d[i + 1], second[i] = (
                lower[i], d[i + 1], upper[i] - factor * d[i + 1], following)
            if i + 1 < n - 1:
                upper[i + 1] = -factor * following
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            d[i] = d[i] or tiny
            factor = lower[i] / d[i]
            d[i + 1] -= factor * upper[i]
            x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        rest = x[i] - (upper[i] * x[i + 1] if i + 1 < n else 0.0) - (
            second[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / (d[i] if abs(d[i]) > tiny * tiny else tiny)
        if abs(x[i]) > 1e150:
            x = [v * 1e-150 for v in x]
    return np.array(x)


def _inverse_iteration(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray
                       ) -> np.ndarray:
    """Eigenvectors of a tridiagonal matrix for eigenvalues that fall."""
    n, random = len(diagonal), np.random.default_rng(7)
    found = np.zeros((n, len(values)))
    close = CLUSTER * np.abs(values).max(initial=0.0)
    begin, shift = 0, 0.0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > close:
            begin = k
        # equal eigenvalues get shifts a little apart
        shift = min(value, shift - 4 * np.spacing(abs(value))) if k > begin else value
        mates = found[:, begin:k]
        x = random.standard_normal(n)
        for _ in range(5):
            x = _solve(diagonal, beside, shift, x / np.linalg.norm(x))
            for _ in range(2):  # once more for what rounding has left
                x = x / np.linalg.norm(x)
                x -= mates @ (mates.T @ x)
        found[:, k] = x / np.linalg.norm(x)
    return found


def _rows(column: pa.Array, dimension: int) -> np.ndarray:
    """Integer form of the vectors (rows) of an array of lists of `dimension` numbers."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * entries.reshape(-1, dimension))
    return np.clip(scaled, -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _exact_sums(x: np.ndarray) -> list[int]:
    """Column sums, exact for any 64-bit entries."""
    return [(int(h) << 32) + int(w) for h, w in
            zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]


def _gather(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimension
        mean, products = np.zeros(dimension), np.zeros((dimension, dimension))
        for batch in batches:
            x = _rows(batch.column(0), dimension)
            if not len(x):
                continue
            own = _exact_sums(x)
            centre = np.array([s / len(x) for s in own])
            y = x - centre
            away, m = centre - mean, len(x)
            products += y.T @ y + np.outer(away, away) * (n * m / (n + m))
            n, sums = n + m, [a + b for a, b in zip(sums, own, strict=True)]
            mean = np.array([s / n for s in sums])
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()),
                 pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0))),
                 pa.array([products.ravel()], pa.list_(pa.float64()))],
                names=["n", "sums", "products"])
    return run


def _moved(mean: np.ndarray):
    """A task's centred products, moved to the mean of all; the upper triangle as rows."""
    upper = np.triu_indices(len(mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for n, sums, products in zip(*(batch.column(k).to_pylist() for k in range(3)),
                                         strict=True):
                away = np.array([int(s) / n for s in sums]) - mean
                moved = np.reshape(products, (len(mean), -1)) + n * np.outer(away, away)
                held = moved if held is None else held + moved
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()),
                 pa.array(held[upper])], names=["i", "j", "v"])
    return run


def _projector(n: int, sums: list[int], mean: np.ndarray, weights: np.ndarray):
    """Projection of each vector, and its exact deviation."""
    dimension = len(mean)
    exact = np.array(sums, dtype=object)
    most = max(map(abs, sums), default=0)

    def deviation(x: np.ndarray) -> list[Decimal | None]:
        reach = n * int(np.abs(x).max(initial=0)) + most  # no difference is larger
        if reach * reach * dimension < 1 << 63:
            d = n * x - exact.astype(np.int64)
            found = (d * d).sum(axis=1).tolist()
        else:
            d = n * x.astype(object) - exact
            found = (d * d).sum(axis=1).tolist()
        return [Decimal(v) if v < 10 ** 38 else None for v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1), dimension)
            if not len(x):
                continue
            y = (x - mean) @ weights
            ends = np.arange(len(x) + 1, dtype=np.int32) * weights.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation(x), pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()))],
                names=["vec_id", "deviation", "whitened"])
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """Whitened projections: one row per remaining vector with vec_id, n (vectors remaining),
    deviation decimal(38,0) (exact; null from 1e38), whitened array<double> (an entry per component),
    explained array<double> (each component's share of the variance) and identity_error (largest
    absolute entry of the whitened rows' covariance minus the identity).

    Vectors that are null or hold a null or non-finite entry go. Where lengths differ, the most
    frequent one counts (the longest of these), and vectors of other lengths go. Repeated rows
    and ids count each, null ids stay. Entries beyond 64 bits are kept at the limit. Components
    without variance are left out (all of them for one vector or equal ones: then the arrays are
    empty and the error is 0). An empty table gives an empty result; other columns are not looked
    at and may clash. More than DIMENSIONS dimensions raise an error."""
    spark = vectors.sparkSession
    kind = vectors.select(id_col).dtypes[0][1]
    sound = (vectors.select(F.col(id_col).alias("vec_id"),
                            F.col(vec_col).cast("array<double>").alias("v"))
             .where("v is not null and forall(v, c -> c is not null and not isnan(c) "
                    "and abs(c) < double('infinity'))"))
    lengths = (sound.groupBy(F.size("v").alias("d")).count()
               .orderBy(F.desc("count"), F.desc("d")).take(1))
    dimension = lengths[0].d if lengths else 0
    if dimension > DIMENSIONS:
        raise ValueError(f"vectors of {dimension} dimensions, {DIMENSIONS} at most")
    schema = (f"vec_id {kind}, n bigint, deviation decimal(38,0), whitened array<double>, "
              "explained array<double>, identity_error double")
    if not lengths:
        return spark.createDataFrame([], schema)
    sound = sound.where(F.size("v") == dimension)
    if not dimension:
        return sound.selectExpr(
            "vec_id", f"{lengths[0]['count']}L as n", "cast(0 as decimal(38,0)) as deviation",
            "v as whitened", "v as explained", "0D as identity_error")

    parts = materialize(sound.select("v").mapInArrow(
        _gather(dimension), "n bigint, sums array<decimal(38,0)>, products array<double>"))
    n = parts.agg(F.sum("n")).first()[0]
    totals = (parts.select(F.posexplode("sums").alias("i", "s")).groupBy("i")
              .agg(F.sum("s").alias("s")).collect())  # one row per dimension
    sums = [0] * dimension
    for row in totals:
        sums[row.i] = int(row.s)
    mean = np.array([s / n for s in sums])
    covariance = np.zeros((dimension, dimension))
    entries = (parts.mapInArrow(_moved(mean), "i int, j int, v double").groupBy("i", "j")
               .agg(F.sum("v").alias("v")).toPandas())  # the upper triangle
    covariance[entries.i, entries.j] = covariance[entries.j, entries.i] = entries.v / n
    values, basis = leading_pairs(covariance, components)
    kept = values > max(values.max(initial=0.0) * LEAST, 0.0)
    values, basis = values[kept], basis[:, kept]
    explained = (values / np.trace(covariance)).tolist()

    rows = materialize(sound.mapInArrow(
        _projector(n, sums, mean, basis / np.sqrt(values)),
        f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"))
    return rows.select(
        "vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.lit(explained).cast("array<double>").alias("explained"),
        F.lit(_identity_error(rows, len(values))).alias("identity_error"))


def _identity_error(rows: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    if not count:
        return 0.0
    w = [F.col("whitened")[k] for k in range(count)]
    means = rows.agg(*[F.avg(c) for c in w]).first()
    centred = [c - F.lit(m) for c, m in zip(w, means, strict=True)]
    entries = [(a, b) for a in range(count) for b in range(a, count)]
    found = rows.agg(*[F.avg(centred[a] * centred[b]) for a, b in entries]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, entries, strict=True))


def whitened_rows(found: DataFrame) -> DataFrame:
    """One row per vector and component of `whiten`, components numbered from 1."""
    return found.select(
        "vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "w"), "n",
        "deviation", "identity_error").select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation",
        "w.whitened", "w.explained", "identity_error")
