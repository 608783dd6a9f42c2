"""Whitening against exact whole numbers and numpy's own decomposition."""

import math
from random import Random

import numpy as np
import pytest

from assaymill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key string, v string, component int, n long"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "k", "v", 7, 8) for i, v in vectors], SCHEMA)


def check(rows, vectors, d, components=32):
    """All columns against x-vectors as Python ints."""
    fit = [(i, v) for i, v in vectors if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in fit]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    cov = y.T @ y / n
    values, vecs = np.linalg.eigh(cov)
    k = min(components, int((values > values[-1] * d * 1e-15).sum()))
    assert len(rows) == n * k
    want = sorted((i, sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True))) for (i, _), r in zip(fit, x, strict=True))
    assert sorted((r.vec_id, r.deviation) for r in rows if r.component == 1) == want
    assert {r.n for r in rows} == {n} and all(r.deviation_exact == str(r.deviation) for r in rows)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-4
    by = {(r.vec_id, r.component): r for r in rows}
    for c in range(k):
        value, vector = values[::-1][c], vecs[:, ::-1][:, c]
        expected, got = y @ vector / math.sqrt(value), np.array([by[i, c + 1].whitened for i, _ in fit])
        near = [values[::-1][o] for o in range(d) if o != c and abs(values[::-1][o] - value) < 1e-6 * value]
        if not near:  # else any base of the shared space will do
            assert min(np.abs(got - expected).max(), np.abs(got + expected).max()) < 1e-6
        assert by[fit[0][0], c + 1].explained == pytest.approx(value / np.trace(cov), rel=1e-9)
    return by


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    by = check(whitening.whiten(df).collect(), vectors, len(vectors[0][1]))
    assert {c for _, c in by} == set(range(1, 33))


def test_edges_repeats_and_clashes(spark):
    r = Random(3)
    fine = [(i, [r.gauss(0, s) for s in (4, 1, 0.2, 0.2, 2)]) for i in range(60)] + [(100, [1.0, 2.0, 0.0, 0.0, 1.0])]
    odd = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [math.nan] * 5), (204, [math.inf, 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, [1e20] * 5)]
    check(whitening.whiten(table(spark, fine + odd).repartition(3)).collect(), fine, 5)
    twice = whitening.whiten(table(spark, [(None, v) for _, v in fine] + [(1, fine[0][1])] * 5), components=2).collect()
    assert len(twice) == 2 * 66 and sum(x.vec_id is None for x in twice) == 122


def test_components_without_variance(spark):
    r = Random(5)
    flat = [(i, [x, 2 * x, 3.0, r.gauss(0, 1)]) for i, x in enumerate(r.choice([-2.0, -1.0, 0.5, 4.0]) for _ in range(50))]
    rows = whitening.whiten(table(spark, flat)).collect()
    assert {x.component for x in rows} == {1, 2} and rows[0].identity_error < 1e-9
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 4)).collect() == []
    assert whitening.whiten(table(spark, [])).collect() == [] == whitening.whiten(table(spark, [(1, None)])).collect()


def test_large_entries_stay_exact(spark):
    r = Random(7)
    vectors = [(i, [float(np.float32(r.uniform(-1e9, 1e9))), r.uniform(-1, 1)]) for i in range(40)]
    rows = whitening.whiten(table(spark, vectors)).collect()
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in vectors]
    want = {i: sum((40 * c - sum(z)) ** 2 for c, z in zip(row, zip(*x, strict=True), strict=True)) for (i, _), row in zip(vectors, x, strict=True)}
    assert {x.vec_id: int(x.deviation_exact) for x in rows} == want
    assert all(x.deviation == (want[x.vec_id] if want[x.vec_id] < 2**63 else None) for x in rows)


def test_rotations_on_graded_and_degenerate_matrices():
    g = np.random.default_rng(2)
    scale = 10.0 ** -np.arange(12)
    base = g.normal(size=(40, 12))
    a = (base * scale).T @ (base * scale)
    values, vectors = whitening.jacobi(a)
    assert np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-13) and np.all(np.diff(values) <= 0)
    exact = np.linalg.svd(base * scale, compute_uv=False) ** 2
    assert np.allclose(values, exact, rtol=1e-6)  # the smallest is 1e-22 of the largest
    for m in (1, 2, 5, 33):
        same, axes = whitening.jacobi(np.ones((m, m)))
        assert same[0] == pytest.approx(m) and np.allclose(axes @ np.diag(same) @ axes.T, 1)
