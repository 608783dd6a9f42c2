"""The stored index: any sequence of changes equals a rebuild of what is there in the end."""

from random import Random

from assaymill.operators.neighbours import nearest
from assaymill.sources import vector_index
from assaymill.sources.vector_index import VectorIndex

SCHEMA = "item_id long, document_id long, vector array<float>, kind string"


def rows(spark, some):
    return spark.createDataFrame([(i, d, v, "k") for i, d, v in some], SCHEMA)


def vector(r, n=3):
    return [float(r.randrange(-8, 9)) for _ in range(n)]


def state(index):
    return {(r.item_id, r.document_id, tuple(r.vector)) for r in index.live().collect()}


def test_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """Adds, replacements, removals by id and document, compactions; searched in the end."""
    monkeypatch.setattr(vector_index, "COMPACT_AFTER", 5)
    r, index, want = Random(1), VectorIndex(spark, str(tmp_path / "i")), {}
    for step in range(9):
        batch = {i: (i, r.randrange(4), vector(r)) for i in r.sample(range(30), 8)}
        assert index.add(rows(spark, batch.values())) == 8
        want |= batch
        if step % 3 == 1:
            ids = r.sample(range(30), 5)
            assert index.remove(ids=spark.createDataFrame([(i,) for i in [*ids, ids[0]]], "item_id long")) == len(set(ids) & set(want))
            want = {i: x for i, x in want.items() if i not in ids}
        if step % 3 == 2:
            assert index.remove(documents=spark.createDataFrame([(2,), (99,)], "document_id long")) == sum(x[1] == 2 for x in want.values())
            want = {i: x for i, x in want.items() if x[1] != 2}
    assert state(index) == {(i, d, tuple(v)) for i, d, v in want.values()}
    assert len(index._log()) < 9
    queries = spark.createDataFrame([(1000 + k, vector(r)) for k in range(4)], "query_id long, vector array<float>")
    found = lambda df: {tuple(x) for x in df.collect()}
    assert found(index.search(queries, 3)) == found(nearest(queries, rows(spark, want.values()), 3))
    before = state(index)
    index.compact()
    assert state(index) == before and index.vacuum() > 0 and state(index) == before
    assert state(VectorIndex(spark, str(tmp_path / "i"))) == before


def test_length_changes_reset_and_odd_rows(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"))
    assert index.dimension == 0 and state(index) == set() and index.remove(ids=spark.createDataFrame([(1,)], "item_id long")) == 0
    assert index.add(rows(spark, [])) == 0 == index.add(rows(spark, [(1, 1, None), (2, 1, [])]))
    nan = float("nan")
    assert index.add(rows(spark, [(1, 1, [1.0, 2.0]), (2, 1, [3.0, 4.0]), (3, 1, [1.0]), (4, 1, [nan, 1.0]), (None, 1, [5.0, 6.0]), (None, 2, [7.0, 8.0])])) == 4
    ids = {i for i, *_ in state(index)}
    assert {1, 2} < ids and len([i for i in ids if i < 0]) == 2 and index.dimension == 2
    index.add(rows(spark, [(None, 3, [9.0, 9.0])]))
    assert len({i for i, *_ in state(index)}) == 5
    index.compact()
    index.add(rows(spark, [(None, 3, [9.0, 8.0])]))
    assert len({i for i, *_ in state(index)}) == 6
    assert index.add(rows(spark, [(7, 1, [1.0, 2.0, 3.0])])) == 1  # another length begins anew
    assert state(index) == {(7, 1, (1.0, 2.0, 3.0))} and index.dimension == 3
    assert index.search(spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<float>")).collect() == []
    index.reset()
    assert state(index) == set()
    index.add(rows(spark, [(8, 1, [1.0, 2.0, 4.0])]))
    assert state(index) == {(8, 1, (1.0, 2.0, 4.0))}


def test_writers_that_die_or_meet(spark, tmp_path):
    """A segment without a commit isn't there; commits of two writers take numbers one after the other; a compaction keeps what came meanwhile."""
    a, b = VectorIndex(spark, str(tmp_path / "i")), VectorIndex(spark, str(tmp_path / "i"))
    a.add(rows(spark, [(1, 1, [1.0, 0.0])]))
    a._written(rows(spark, [(9, 9, [9.0, 9.0])]), "segments")
    (tmp_path / "i/log/000000000001.json").write_text('{"kind": "add", "fold')
    b.add(rows(spark, [(2, 1, [0.0, 1.0])]))
    assert {i for i, *_ in state(a)} == {1, 2}
    held, written = a._log(), a._written

    def slow(rows_, kind):
        a._written = written
        b.add(rows(spark, [(3, 1, [1.0, 1.0])]))
        b.remove(ids=spark.createDataFrame([(1,)], "item_id long"))
        return written(rows_, kind)

    a._written = slow
    a.compact()
    assert len(held) == 2 and {i for i, *_ in state(b)} == {2, 3} == {i for i, *_ in state(a)}
