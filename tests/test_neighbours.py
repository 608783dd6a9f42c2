"""Exact neighbours against brute force, with groups and shares so small that everything is cut."""

from random import Random

import numpy as np
import pytest

from assaymill.operators import neighbours as N

SCHEMA = "query_id long, item_id long, vector array<float>, doc int, kind string, cell int, g long, score double"


def brute(rows, queries, k, same=None, other=None, least=None, itself=False, later=False):
    out = set()
    for q in queries:
        found = []
        for i in rows:
            if i is q and not itself or i[0] == q[0] and not itself:
                continue
            if same is not None and (q[same] is None or i[same] != q[same]):
                continue
            if other is not None and q[other] is not None and i[other] == q[other]:
                continue
            score = round(float(np.dot(np.array(q[1], float), np.array(i[1], float))), N.DIGITS)
            if least is None or score >= least:
                found.append((-score, -i[0] if later else i[0]))
        out |= {(q[0], abs(i) if later else i, n + 1, round(-s, 9)) for n, (s, i) in enumerate(sorted(found)[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[0], r[1], r[2], r[3], 1, 2, 3.0) for r in rows], SCHEMA)


def got(df):
    return {(r.query_id, r.item_id, r.rank, round(r.score, 9)) for r in df.collect()}


def clustered(seed=1, n=260, dim=6):
    r = Random(seed)
    centres = [[r.gauss(0, 3) for _ in range(dim)] for _ in range(7)]
    rows = []
    for i in range(n):
        v = [c + r.gauss(0, 0.3) for c in r.choice(centres)]
        rows.append((i, [float(np.float32(x)) for x in v], r.choice((1, 2, 3, None)), r.choice(("a", "b", None))))
    rows += [(n + i, rows[0][1], 1, "a") for i in range(40)]  # one vector, many times
    return rows + [(900, [0.0] * dim, 1, "a")]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(N, "GROUP_BYTES", 900)
    monkeypatch.setattr(N, "QUERY_BYTES", 600)
    monkeypatch.setattr(N, "SCORES", 50)


@pytest.mark.parametrize("options", [{}, {"itself": True}, {"later": True}, {"same": ["kind"], "other": ["doc"]}, {"least": 20.0}, {"other": ["doc", "kind"], "k": 3}])
def test_against_brute_force(spark, small, options):
    rows = clustered()
    k = options.get("k", 5)
    want = {key: v for key, v in options.items() if key not in ("same", "other", "k")}
    if "same" in options:
        want |= {"same": 3, "other": 2}
    elif "other" in options:
        rows = [(i, v, d, None if d is None or c is None else c) for i, v, d, c in rows]
        rows = [(i, v, (d, c) if d is not None and c is not None else None, c) for i, v, d, c in rows]
        want |= {"other": 2}
        df = spark.createDataFrame([(r[0], r[0], r[1], r[2] and r[2][0], r[2] and r[2][1], 1, 2, 3.0) for r in rows], SCHEMA)
        assert got(N.nearest(df, df, **options)) == brute(rows, rows, k, **want)
        return
    df = frame(spark, rows).repartition(3)
    assert got(N.nearest(df, df, **options)) == brute(rows, rows, k, **want)


def test_one_group_and_few_queries(spark):
    rows = clustered(3, 80)
    df = frame(spark, rows)
    assert got(N.nearest(df.where("query_id % 9 = 0"), df, 4)) == brute(rows, [r for r in rows if r[0] % 9 == 0], 4)


def test_odd_rows(spark, small):
    fine = clustered(5, 30)
    odd = [(None, fine[0][1], 1, "a"), (700, None, 1, "a"), (701, [], 1, "a"), (702, [1.0, 2.0], 1, "a"), (703, [float("nan")] * 6, 1, "a"), (704, [None] * 6, 1, "a")]
    df = frame(spark, fine + odd)
    assert got(N.nearest(df, df)) == brute(fine, fine, 5)
    none = frame(spark, [])
    assert got(N.nearest(none, df)) == set() == got(N.nearest(df, none)) == got(N.nearest(frame(spark, odd[1:3]), frame(spark, odd[1:3])))


def test_bounds_skip_most_cells_of_clusters():
    """No inner product exceeds its cell's bound, and on clusters few cells reach a query's own score."""
    g = np.random.default_rng(3)
    centres = g.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.repeat(centres, 50, 0) + 0.02 * g.normal(size=(2000, 16))
    cell = np.repeat(np.arange(40), 50)
    far = np.linalg.norm(x - centres[cell], axis=1).reshape(40, 50).max(1)
    cells = N.Cells(np.arange(40), centres, far, np.linalg.norm(x, axis=1).reshape(40, 50).max(1), cell, cell)
    bound, score = N.bounds(x, cells), (x @ x.T).reshape(2000, 40, 50).max(2)
    assert (bound >= score).all()
    fifth = np.sort(x @ x.T, 1)[:, -6]
    assert (bound >= fifth[:, None]).mean() < 0.1


def test_queries_meet_only_groups_of_their_labels(spark):
    """Items of other labels can't count, so a query isn't sent to groups that hold only such items."""
    x = np.random.default_rng(3).normal(size=(400, 8))
    there = N.usable(frame(spark, [(i, v.tolist(), None, "ab"[i % 2]) for i, v in enumerate(x)]), "item_id", 8, ["kind"]).withColumn("bucket", N._bucket(["kind"]))
    known = np.array(sorted({r.bucket for r in there.select("bucket").collect()}))
    assert len(known) == 2
    dealt = N._dealt(there, x[:5], known)
    cells = N._cells(dealt, x[:5], known)
    assert len(cells.number) == 10 and not set(cells.group[cells.bucket == known[0]]) & set(cells.group[cells.bucket == known[1]])
    asked = there.selectExpr("*", "double('-infinity') AS least", "-1L AS done")
    of = {r.id: r.bucket for r in there.select("id", "bucket").collect()}
    for first in (True, False):
        met = N._routes(asked, cells, first).select("g", "id").collect()
        assert {r.id for r in met} == set(range(400))
        assert all(r.g >> 20 in cells.group[cells.bucket == of[r.id]] for r in met)
