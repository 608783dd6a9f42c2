"""Mixing against a plain Python version of targets, draws, permutations and blocks."""

import re
import struct
from bisect import bisect_right
from collections import Counter, defaultdict
from fractions import Fraction
from random import Random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from assaymill.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target double, src long"


def hashed(*values):
    seed = 42
    for v in values:
        seed = xxh64_intdigest(struct.pack("<q", v), seed)
    return seed


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Reshares step by step, as the rule is told."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    stopped, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        total = sum(weight[s] for s in free)
        now = {s: (left - sum(stopped.values())) * weight[s] / total for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return names, stopped | now
        stopped |= {s: Fraction(most * sizes[s]) for s in over}
        if len(stopped) == len(names):
            return names, stopped


def permuted(i, size, *keys):
    for r in range(1, mixing.ROUNDS + 1):
        other = (signed(hashed(*keys, r)) % size - i) % size
        if hashed(*keys, r, max(i, other)) & 1:
            i = other
    return i


def slots(names, sizes, target, block, shard, seed=42):
    """Counter of (source, index, words) and the counts of each shard."""
    n, passes, rest, per = {}, {}, {}, {}
    for s in names:
        w = max(sizes[s], 1)
        quota = int(target[s] + Fraction(1, 2))
        passes[s], rest[s] = divmod(quota, w)
        per[s] = -(-sizes[s] // block)
        n[s] = passes[s] * per[s] + -(-rest[s] // block)
    total, ends, so_far = sum(n.values()), [], 0
    for s in names:
        so_far += n[s]
        ends.append(so_far)
    drawn, shards = Counter(), defaultdict(Counter)
    for i in range(total):
        s = names[bisect_right(ends, int((hashed(seed, i) >> 11) / 2.0**53 * total))]
        if drawn[s] < n[s]:
            shards[i // shard][s] += 1
        drawn[s] += 1
    out = Counter()
    for k, s in enumerate(names):
        blocks = sizes[s] // block
        for j in range(n[s]):
            lap, i = divmod(j, per[s])
            index = permuted(i, blocks, seed, k + 1, lap) if i < blocks else blocks
            there = block if i < blocks else sizes[s] % block
            out[s, index, min(there, rest[s] - i * block) if lap == passes[s] else there] += 1
    return out, shards, n


def check(spark, rows, block=16, shard=50):
    df = spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], SCHEMA)
    got = mixing.mix(df, block=block, shard=shard).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    names, want = targets(sizes)
    assert len(got) == len(rows) and sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), count(t)) for i, t, _ in rows)
    by = defaultdict(list)
    ids = defaultdict(set)
    for i, _, s in rows:
        ids[i].add(s)
    for r in got:
        assert r.taken <= 2 * r.size
        if len(ids[r.doc_id]) == 1:
            (s,) = ids[r.doc_id]
            by[s].append(r)
            assert r.source_size == sizes[s] and r.target == pytest.approx(float(want[s]), rel=1e-9, abs=1e-9)
    for s, found in by.items():
        if len(found) == sum(x[2] == s for x in rows):
            assert abs(sum(r.taken for r in found) - want[s]) <= 0.5
    return df, got, names, sizes, want


def corpus(seed=1, n=150):
    r = Random(seed)
    rows = [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.choice((0, 1, 3, 40, 90)))), r.choice(("a", "a", "a", "B", "é", "tiny", None, "z", "\U0001f600"))) for i in range(n)]
    return [(i, t, "c" if s == "tiny" and i > 30 else s) for i, t, s in rows] + [(1000, None, "a"), (1001, " \t\n", "empty"), (1002, "long " * 5000, "B"), (1003, " x y", "q")]


def test_documents_against_plain_python(spark):
    """Layout comes from the operator, all that is taken from the plain version."""
    rows = corpus()
    df, got, names, sizes, want = check(spark, rows)
    chosen, shards, n = slots(names, sizes, want, 16, 50)
    with mixing.run_folder(spark, "test"):
        found = mixing.mixture(df, block=16, shard=50)
        layout = found.layout.where("size > 0").collect()
        at = {r.src - 1: r.source for r in found.sources.collect()}
        assert [at[i] for i in range(len(at))] == names
        here = Counter((names[r.src - 1], r["index"], r.n_words) for r in found.slots.collect())
        counted = {(r.shard, names[r.src - 1]): r.n for r in mixing.shard_counts(spark, found.sources, 50, 42).collect()}
    assert here == chosen
    assert all(counted.get((k, s), 0) == c for k, x in shards.items() for s, c in x.items())
    assert sum(counted.values()) == sum(n.values())
    ends = defaultdict(int)
    for r in sorted(layout, key=lambda r: (r.src, r.start)):  # documents lie one after the other
        assert r.start == ends[r.src]
        ends[r.src] += r.size
    taken = Counter()
    for r in layout:
        for (s, index, words), times in chosen.items():
            if s == r.source:
                low, high = max(r.start, index * 16), min(r.start + r.size, index * 16 + words)
                taken[r.doc_id] += times * max(0, high - low)
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: taken[r.doc_id] for r in got}


def test_permutations():
    for size in (1, 2, 7, 100):
        places = [permuted(i, size, 42, 3, 0) for i in range(size)]
        assert sorted(places) == list(range(size))
    assert places != [permuted(i, 100, 42, 3, 1) for i in range(100)] != list(range(100))


def test_repeated_and_null_keys(spark):
    rows = [(None, "one two three", "a"), (None, "four", "a"), (None, "four", "b"), (7, "x y z", "a"), (7, "x y z", "a"), (7, "other words", "b"), (8, None, None), (8, "", None)]
    check(spark, rows, block=2, shard=3)
    check(spark, [(1, "word " * 3, "a")] * 200 + [(2, "word " * 7000, "b")], block=4)


def test_partitioning_changes_nothing(spark):
    df = spark.createDataFrame([(*r, 1, 2.0, 3) for r in corpus(4)], SCHEMA)
    key = lambda x: sorted(map(tuple, mixing.mix(x, block=8).collect()))
    assert key(df.repartition(7)) == key(df.coalesce(1).orderBy(F.rand(1)))


def test_small_groups_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 5)
    monkeypatch.setattr("assaymill.llm.common.ROWS_AT_ONCE", 0)
    check(spark, corpus(9), block=8, shard=7)


def test_no_rows_and_no_words(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a", 1, 1.0, 1), (2, " ", None, 1, 1.0, 1)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_texts_are_the_taken_words(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(n)), s) for i, (n, s) in enumerate([(30, "a"), (5, "a"), (0, "a"), (64, "b"), (3, "c"), (41, None)])]
    df, got, names, sizes, want = check(spark, rows, block=8, shard=6)
    out = mixing.mixed_texts(df, block=8, shard=6).collect()
    words = Counter(w for r in out for w in r.text.split(" "))
    assert all(sum(c for w, c in words.items() if w.startswith(f"d{r.doc_id}w")) == r.taken for r in got)
    assert max(words.values()) <= 2 and len({(r.shard, r.place) for r in out}) == len(out)
    assert all(len(r.text.split(" ")) <= 8 for r in out)
