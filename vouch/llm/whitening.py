"""Embedding whitening: covariance by Spark in two passes, leading components by numpy, and one projection of all rows.

Entries become whole numbers (64ths, rounded down, moved up by OFFSET). The fit list is every distinct vector once, written
as a table. Its sums are exact; a second pass adds up products of centred entries, one small matrix a task, summed by
place. What the driver holds is the matrix, whose size depends on the dimension alone. Householder reflections make it
tridiagonal, bisection by Sturm counts finds the leading eigenvalues, and inverse iteration, orthogonalised anew within
clusters of close eigenvalues, their vectors. The projection is sent to all tasks. Two further passes over the fit list
measure how far the whitened covariance is from the identity.

Rows whose vector is null, or holds a null or a value that is not finite, go, and so do those with an entry beyond 2**50.
The dimension is the most frequent length of the others (of equals the largest); rows of another length, and empty
vectors, have no components. Components whose eigenvalue is not above rounding error (all of them where one vector alone is left)
cannot be scaled and are left out, so constant dimensions do no harm. Rows that repeat a vec_id or a vector all stay, a null vec_id
too; an empty table gives an empty result; no columns but vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.llm.common import arrow_schema, written

SCALE, OFFSET, TOP = 64, 1_000_000, 16
#: Entries of a greater size are not whole numbers of 64ths any more that a long can hold with room for sums.
MOST = float(1 << 50)
#: Eigenvalues nearer than this share of the matrix's norm are one cluster.
CLUSTER = 1e-3


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with per-dimension sums; eigenvalues and (by column) vectors of the leading components; the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the difference is exact before it is divided."""
        return _scaled(x, self.n, self.sums).astype(float) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: as Python's integers where 64 bits would not do."""
    most = max(int(np.abs(x).max(initial=0)), 1) * n
    return n * x - sums if most < 1 << 61 else n * x.astype(object) - sums.astype(object)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum of squares of n * x - sums for each row; null where it is beyond a long."""
    y = _scaled(x, n, sums)
    if y.dtype != object and float(np.abs(y.astype(float)).max(initial=0)) ** 2 * y.shape[1] < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    exact = (y.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, next diagonal, and the Householder vectors (each acts from its own place on)."""
    a, d, reflectors = matrix.astype(float).copy(), len(matrix), []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) == 0:
            reflectors.append(np.zeros_like(v))
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * rest @ v
        p -= (p @ v) * v
        rest -= np.outer(v, p) + np.outer(p, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        reflectors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are less than each value."""
    tiny = np.finfo(float).tiny ** 0.5 + np.finfo(float).eps ** 2 * np.abs(off).max(initial=0)
    q, less = diagonal[0] - at, np.zeros(len(at), np.int64)
    for i in range(len(diagonal)):
        if i:
            q = diagonal[i] - at - off[i - 1] ** 2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        less += q < 0
    return less


def leading_values(diagonal: np.ndarray, off: np.ndarray, top: int) -> np.ndarray:
    """The `top` greatest eigenvalues, falling, by bisection of all at once."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low = np.full(min(top, d), (diagonal - reach).min())
    high = np.full(min(top, d), (diagonal + reach).max())
    wanted = d - 1 - np.arange(min(top, d))
    for _ in range(200):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = sturm_counts(diagonal, off, middle) > wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return (low + high) / 2


def _factored(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float) -> list[tuple[bool, float, float, float, float]]:
    """Elimination with row exchanges of the shifted matrix: for each row whether it was exchanged, its factor, and its three entries."""
    d, rows = len(diagonal), []
    a, b, c = diagonal[0] - shift, off[0] if d > 1 else 0.0, 0.0
    for i in range(d - 1):
        lower, mid, upper = off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < d else 0.0
        swap = abs(lower) > abs(a)
        if swap:
            (a, b, c), (lower, mid, upper) = (lower, mid, upper), (a, b, c)
        a = a if abs(a) > tiny else tiny
        factor = lower / a
        rows.append((swap, factor, a, b, c))
        a, b, c = mid - factor * b, upper - factor * c, 0.0
    rows.append((False, 0.0, a if abs(a) > tiny else tiny, 0.0, 0.0))
    return rows


def _solved(rows: list[tuple[bool, float, float, float, float]], right: np.ndarray) -> np.ndarray:
    y = right.tolist()
    for i, (swap, factor, *_) in enumerate(rows[:-1]):
        if swap:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= factor * y[i]
    for i in range(len(rows) - 1, -1, -1):
        _, _, a, b, c = rows[i]
        y[i] = (y[i] - (b * y[i + 1] if i + 1 < len(y) else 0.0) - (c * y[i + 2] if i + 2 < len(y) else 0.0)) / a
    return np.array(y)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (by column) of falling eigenvalues; those of a cluster are orthogonalised against each other at each step."""
    norm = float((np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max()) or 1.0
    tiny, rng = np.finfo(float).eps * norm, np.random.default_rng(12)
    out, cluster = np.zeros((len(diagonal), len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            cluster = j
        # equal eigenvalues are told apart by a few units of rounding
        rows = _factored(diagonal, off, float(value) - (j - cluster) * 2 * tiny, tiny)
        y = rng.standard_normal(len(diagonal))
        for _ in range(5):
            y = _solved(rows, y / np.abs(y).max())
            y /= np.linalg.norm(y)
            for _ in range(2):
                y -= out[:, cluster:j] @ (out[:, cluster:j].T @ y)
            y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def leading_components(matrix: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues (falling) of a symmetric matrix, and their unit eigenvectors by column."""
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, off, top)
    vectors = inverse_iteration(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    return values, vectors


def whole_entries(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (whole numbers) of the rows whose vectors are finite throughout."""
    c = F.col("embedding").cast("array<double>")
    kept = embeddings.select("vec_id", c.alias("c")).filter(F.col("c").isNotNull() & F.forall("c", lambda v: F.coalesce(F.abs(v) <= MOST, F.lit(False))))
    return kept.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE) + OFFSET).cast("array<bigint>").alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[int, np.ndarray]:
    """The number of rows, and the sum of each dimension (of the function's, if there is one): one row a task and dimension."""
    ddl = "place int, n long, whole long, part double"
    schema = arrow_schema(ddl)

    def run(batches):
        n, total = 0, 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, total = n + len(x), total + (of(x) if of else x).sum(axis=0)
        if n:
            whole, part = (np.zeros(len(total), np.int64), total) if of else (total, np.zeros(len(total)))
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([n] * len(total), pa.int64()), pa.array(whole), pa.array(part)], schema=schema)

    rows = sorted(fit.mapInArrow(run, ddl).groupBy("place").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"), F.sum("part").alias("part")).collect(), key=lambda r: r.place)
    return (rows[0].n if rows else 0), np.array([r.part if of else r.whole for r in rows])


def _covariance(fit: DataFrame, d: int, n: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The mean of products of centred rows; a task sends its upper triangle, and entries are summed by place."""
    ddl = "place long, v double"
    schema = arrow_schema(ddl)

    def run(batches):
        total = None
        for batch in batches:
            y = centred(_matrix(batch.column(0), d))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i * len(total) + j, pa.int64()), pa.array(total[i, j])], schema=schema)

    rows = fit.mapInArrow(run, ddl).groupBy("place").agg(F.sum("v").alias("v")).collect()
    size = int(round(((8 * len(rows) + 1) ** 0.5 - 1) / 2))
    out = np.zeros((size, size))
    for place, v in rows:
        i, j = divmod(place, size)
        out[i, j] = out[j, i] = v / n
    return out


def fitted(rows: DataFrame, top: int = TOP) -> Whitening | None:
    """Fits the whitening to the distinct vectors of whole_entries(); None where there is nothing to fit."""
    lengths = rows.groupBy(F.size("x").alias("d")).count().filter("d > 0")
    length = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return None
    d = int(length.d)
    fit = written(rows.filter(F.size("x") == d).select("x").distinct(), "fit-list")
    n, sums = _sums(fit, d)
    plain = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    covariance = _covariance(fit, d, n, plain.centred)
    trace = float(np.trace(covariance))
    values, vectors = leading_components(covariance, top)
    solid = values > max(trace, 0.0) * d * np.finfo(float).eps
    found = Whitening(n, sums, values[solid], vectors[:, solid], trace)
    if not solid.any():
        return found
    mean = _sums(fit, d, found.project)[1] / n
    error = np.abs(_covariance(fit, d, n, lambda x: found.project(x) - mean) - np.eye(int(solid.sum()))).max()
    return Whitening(n, sums, values[solid], vectors[:, solid], trace, float(error))


def projected(rows: DataFrame, whitening: Whitening) -> DataFrame:
    """vec_id, deviation, and whitened (an entry for each component) of whole_entries()."""
    d, ddl = len(whitening.sums), "vec_id long, deviation long, whitened array<double>"
    schema, shared = arrow_schema(ddl), rows.sparkSession.sparkContext.broadcast(whitening)

    def run(batches):
        w = shared.value
        k = len(w.values)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            listed = pa.ListArray.from_arrays(at, pa.array(w.project(x).ravel())).cast(schema.field("whitened").type)
            yield pa.record_batch([batch.column(0), pa.array(deviations(x, w.n, w.sums), pa.int64()), listed], schema=schema)

    return rows.filter(F.size("x") == d).mapInArrow(run, ddl)


def whitened(embeddings: DataFrame, top: int = TOP) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_entries(embeddings.withColumn("vec_id", F.col("vec_id").cast("long")))
    fit = fitted(rows, top)
    if fit is None or not len(fit.values):
        return embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*(F.lit(float(v / fit.trace)) for v in fit.values))
    spread = projected(rows, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return spread.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(fit.identity_error).alias("identity_error")
    )
