"""Whitening of embeddings: exact sums, a distributed centred scatter, cyclic Jacobi rotations on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

#: Entries become long x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Longest vector: the driver holds its square of doubles three times, tasks the square once.
LONGEST = 4096
#: Entries of a larger magnitude count as non-finite: their x is not exact as a double.
LARGEST = float(2**46)
#: Rows that a task multiplies at a time.
ROWS = 2048
#: Sweeps of rotations; they stop once no rotation is needed, after some 6 to 12.
SWEEPS = 60


class Whitening(NamedTuple):
    """What whitens: rows n, sums S of each dimension, components (rows, unit vectors), their eigenvalues, the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    A sweep rotates each pair of dimensions once, in rounds of disjoint pairs, and ends the work once every
    off-diagonal entry is small against its own two diagonal entries; that keeps small eigenvalues accurate.
    """
    a, m = np.array(a, float), len(a)
    vectors, size = np.eye(m), m + m % 2
    ring = np.arange(size)
    eps = np.finfo(float).eps
    for _ in range(SWEEPS if m > 1 else 0):
        rotated = False
        for _ in range(size - 1):
            p, q = np.minimum(ring[: size // 2], ring[::-1][: size // 2]), np.maximum(ring[: size // 2], ring[::-1][: size // 2])
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            p, q = p[q < m], q[q < m]
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            needed = np.abs(off) > eps * np.sqrt(np.abs(dp * dq))
            if not needed.any():
                continue
            rotated, p, q, off, dp, dq = True, p[needed], q[needed], off[needed], dp[needed], dq[needed]
            theta = (dq - dp) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for x in (a, vectors):  # columns
                x[:, p], x[:, q] = x[:, p] * c - x[:, q] * s, x[:, p] * s + x[:, q] * c
            a[p], a[q] = a[p] * c[:, None] - a[q] * s[:, None], a[p] * s[:, None] + a[q] * c[:, None]
            a[p, p], a[q, q] = dp - t * off, dq + t * off
            a[p, q] = a[q, p] = 0
        if not rotated:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


def _usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, v): vectors of doubles, all finite."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))  # NaN is the largest
    return vectors.select(F.col(key).alias("key"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def _dimension(usable: DataFrame) -> int:
    """The most frequent length, the larger of two such; 0 without rows."""
    best = usable.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return best.d if best else 0


def _longs(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """x of a batch, one row a vector."""
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield some, _longs(some, d)


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and S, exactly."""

    def task(batches):
        total, n = [0] * d, 0
        for _, x in _blocks(batches, d):
            n += len(x)
            high, low = (x >> 30).sum(0), (x & (2**30 - 1)).sum(0)  # neither can overflow
            total = [t + (int(h) << 30) + int(b) for t, h, b in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([str(n), *map(str, total)])], ["i", "x"])

    found = rows.mapInArrow(task, "i int, x string").groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # d + 1 rows
    by = {r.i: int(r.x) for r in found}
    return by.get(-1, 0), [by.get(i, 0) for i in range(d)]


def _scatter(rows: DataFrame, d: int, made, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of y and of y y' over all rows, where ``made`` turns a block of x into y of m columns.

    Tasks add up blocks; the tasks' sums meet row by row of the matrix, so nothing grows with the number of tasks
    but the shuffle.
    """

    def task(batches):
        total, first = np.zeros((m, m)), np.zeros(m)
        for _, x in _blocks(batches, d):
            y = made(x)
            total += y.T @ y
            first += y.sum(0)
        i, j = np.triu_indices(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(m, -1), i]), pa.int32()), pa.array(np.concatenate([np.arange(m), j]), pa.int32()), pa.array(np.concatenate([first, total[i, j]]))], ["i", "j", "x"])

    first, total = np.zeros(m), np.zeros((m, m))
    for i, j, x in rows.mapInArrow(task, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toLocalIterator():
        if i < 0:
            first[j] = x
        else:
            total[i, j] = total[j, i] = x
    return first, total


def _centring(n: int, sums: list[int]):
    """x - S / n: the nearest whole number goes exactly, the rest as a double."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    whole = np.array(whole, np.int64)
    return lambda x: (x - whole) - rest


def fit(rows: DataFrame, d: int) -> Whitening | None:
    """Fits on all rows (key, v) of length d; None without rows."""
    n, sums = _sums(rows, d)
    if not n:
        return None
    first, scatter = _scatter(rows, d, _centring(n, sums), d)
    values, vectors = jacobi((scatter - np.outer(first, first) / n) / n)
    values = np.maximum(values, 0)
    # an eigenvalue of rounding errors has no direction to scale
    able = values > max(values[0] * d * np.finfo(float).eps * 4, 0)
    return Whitening(n, sums, vectors.T[able], values[able], float(values.sum()))


def whiten(vectors: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable vector and component.

    ``deviation`` is the exact squared distance from the mean times n squared, and null where a long can't hold it;
    ``deviation_exact`` is the same as text, always. ``identity_error`` is measured in a pass of its own over all
    whitened rows. Signs of components are those that make their largest entry positive, the first of equal ones.

    Vectors that are null or empty, that hold null, infinite, NaN or entries of 2^46 and more, or that are not as long
    as most (the longer of two equally frequent lengths) are left out and not fitted to. Null keys, repeated keys and
    repeated rows are rows like any other. Components without variance (eigenvalue zero but for rounding) can't be
    scaled to one and are left out, so a table whose vectors are all equal, or an empty one, gives no rows. Only the
    named columns are read. Vectors above 4096 entries are an error.
    """
    spark = vectors.sparkSession
    ready(spark)
    kind = vectors.schema[key].dataType.simpleString()
    usable = _usable(vectors, vector, key)
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    d = _dimension(usable)
    if d > LONGEST:
        raise ValueError(f"vectors of {d} entries; {LONGEST} at most")
    rows = usable.where(F.size("v") == d)
    found = fit(rows, d) if d else None
    if found is None or not len(found.eigenvalues):
        return spark.createDataFrame([], schema)
    n, sums, centred = found.n, found.sums, _centring(found.n, found.sums)
    matrix = found.components[:components]
    matrix = matrix * np.where(np.take_along_axis(matrix, np.abs(matrix).argmax(1)[:, None], 1) < 0, -1, 1) / np.sqrt(found.eigenvalues[:components])[:, None]
    k = len(matrix)
    first, second = _scatter(rows, d, lambda x: centred(x) @ matrix.T, k)
    error = float(np.abs((second - np.outer(first, first) / n) / n - np.eye(k)).max())
    explained = found.eigenvalues[:k] / found.trace
    whole = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = [s - int(w) * n for s, w in zip(sums, whole, strict=True)]  # n x - S = n (x - whole) - rest
    squares = sum(r * r for r in rest)

    def distances(x: np.ndarray) -> list[int]:
        """Sums of (n x - S)^2 from whole sums of y^2 and y rest, where y = x - whole."""
        y = x - whole
        most = float(np.abs(y).max())
        if max(d * most**2, most * sum(map(abs, rest))) < 2**62:
            own, mixed = (y * y).sum(1), y @ np.array(rest, np.int64)
        else:
            exact = y.astype(object)
            own, mixed = (exact * exact).sum(1), exact @ np.array(rest, object)
        return [n * n * int(a) - 2 * n * int(b) + squares for a, b in zip(own, mixed, strict=True)]

    def task(batches):
        for batch, x in _blocks(batches, d):
            z, each = centred(x) @ matrix.T, distances(x)
            rows_of = pa.array(np.repeat(np.arange(len(x)), k))
            long = pa.array([v if v < 2**63 else None for v in each], pa.int64())
            columns = [
                batch.column("key").take(rows_of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), long.take(rows_of), pa.array(z.ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)), pa.array(list(map(str, each)), pa.string()).take(rows_of),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(task, schema)
