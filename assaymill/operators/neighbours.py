"""Exact nearest neighbours of many vectors at once, and candidates for questions across segments.

Items are dealt to cells around sampled centres, cells to groups of bounded bytes. A query first searches the group of
its best centre, which gives it a score to beat; then only groups with a cell whose bound reaches that score get it.
Where labels must be equal, cells and groups are of one bucket of labels, so a query meets no group of another one.
Whatever the sample, results are exact: it decides how much is searched, not what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.records import label
from assaymill.functions.scoring import dot
from assaymill.functions.text import statement_key
from assaymill.operators.terms import TermIndex, shared_terms
from assaymill.plans.session import checkpoints

#: Bytes of all centres; of the item vectors of a group; of the query vectors that a task takes with it.
CENTRE_BYTES, GROUP_BYTES, QUERY_BYTES = 4 << 20, 16 << 20, 16 << 20
#: Scores that a task holds at a time.
SCORES = 4 << 20
#: Scores are rounded to so many digits, so that equal vectors tie wherever they are.
DIGITS = 12
#: More than rounding to so many digits adds to a score, of 1 and its size.
SLACK = 1e-11
#: Buckets of labels at most; items and queries of different ones never meet.
BUCKETS = 64


class Cells(NamedTuple):
    """Numbers and centres of the cells in use, and for each its bucket, radius, greatest norm, group and into how many parts it is cut."""

    number: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    group: np.ndarray
    parts: np.ndarray
    bucket: np.ndarray | None = None


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def usable(rows: DataFrame, key: str, dim: int, same: Sequence[str] = (), other: Sequence[str] = ()) -> DataFrame:
    """(id, vector, same, other): rows with a key and a vector of the length, all of whose entries are finite."""
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    fit = F.col(key).isNotNull() & (F.size("vector") == dim) & finite
    return rows.where(fit).select(F.col(key).cast("long").alias("id"), F.col("vector"), label(same).alias("same"), label(other).alias("other"))


def length_of(items: DataFrame, vector: str = "vector") -> int:
    """The most frequent length of a vector, the larger of two; 0 without any."""
    best = items.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return best.d if best else 0


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (centres * centres).sum(1)[None] - 2 * x @ centres.T
    cell = squares.argmin(1)
    return cell, np.sqrt(((x - centres[cell]) ** 2).sum(1))


def _bucket(same: Sequence[str]) -> Column:
    """The bucket of a row's label ``same``; one for all without labels."""
    return F.pmod(F.xxhash64("same"), F.lit(BUCKETS)).cast("int") if same else F.lit(0)


def _dealt(items: DataFrame, centres: np.ndarray, known: np.ndarray) -> DataFrame:
    """Adds each item's cell, its distance from the centre and its norm. A cell is a centre's items of one of the ``known`` buckets."""
    dim, kind = centres.shape[1], items.schema["vector"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"), dim)
            cell, far = _nearest_centre(x, centres)
            cell += np.searchsorted(known, b.column("bucket").to_numpy()) * len(centres)
            b = b.select(["id", "vector", "same", "other"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((x * x).sum(1)))], [*b.schema.names, "cell", "far", "norm"])

    return items.mapInArrow(go, f"id long, vector {kind}, same string, other string, cell int, far double, norm double")


def _cells(dealt: DataFrame, centres: np.ndarray, known: np.ndarray) -> Cells:
    """Counts, radii and groups: cells of a bucket near each other share a group, larger ones are cut into parts with groups of their own."""
    stats = {r.cell: r for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()}  # a row a centre and bucket
    used = np.array(sorted(stats), int)
    bucket, centres = known[used // len(centres)], centres[used % len(centres)]
    n = np.array([stats[c].n for c in used])
    size = 8 * centres.shape[1]
    parts = -(-n * size // GROUP_BYTES)
    seeds = centres[: max(1, int(-(-n.sum() * size // GROUP_BYTES)))]
    order = np.lexsort([np.arange(len(used)), _nearest_centre(centres, seeds)[0], bucket])
    group, held, at, last = np.zeros(len(used), int), 0, 0, None
    for c in order:
        if held and (parts[c] > 1 or held + n[c] * size > GROUP_BYTES or bucket[c] != last):
            at, held = at + 1, 0
        group[c], held, last = at, held + n[c] * size, bucket[c]
        if parts[c] > 1:
            at, held = at + 1, 0
    return Cells(used, centres, np.array([stats[c].far for c in used]), np.array([stats[c].norm for c in used]), group, parts, bucket)


def bounds(queries: np.ndarray, cells: Cells) -> np.ndarray:
    """For each query and cell, what no inner product with an item of the cell exceeds: by the radius, and by distances."""
    inner, norms = queries @ cells.centres.T, np.sqrt((queries * queries).sum(1))[:, None]
    far = np.sqrt(np.maximum(norms**2 + (cells.centres**2).sum(1)[None] - 2 * inner, 0))
    near = np.maximum(far - cells.radius[None] * (1 + 1e-9) - 1e-7 * (norms + 1), 0)
    by_radius, by_distance = inner + norms * cells.radius[None], (norms**2 + cells.norm[None] ** 2 - near**2) / 2
    return np.minimum(by_radius, by_distance) + 1e-9 * (1 + np.abs(by_radius))


def _routes(queries: DataFrame, cells: Cells, first: bool) -> DataFrame:
    """(g, query rows): the group of the best centre, or, with ``least`` and ``done`` known, all others of the bucket that can hold a better item."""
    dim, kind = cells.centres.shape[1], queries.schema["vector"].dataType.simpleString()
    groups = int(cells.group.max()) + 1
    parts = np.ones(groups, int)
    np.maximum.at(parts, cells.group, cells.parts)
    own = {v: np.flatnonzero(cells.bucket == v) for v in np.unique(cells.bucket).tolist()}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step := max(1, SCORES // len(cells.group))):
                b = whole.slice(at, step)
                q, bucket = _matrix(b.column("vector"), dim), b.column("bucket").to_numpy()
                least = None if first else b.column("least").to_numpy()
                seen = np.zeros((len(q), groups), bool)
                for v in set(bucket.tolist()) & own.keys():
                    some = np.flatnonzero(bucket == v)
                    if first:
                        seen[some, cells.group[own[v][(q[some] @ cells.centres[own[v]].T).argmax(1)]]] = True
                    else:
                        r, c = np.nonzero(bounds(q[some], Cells(*(f[own[v]] for f in cells))) >= least[some][:, None])
                        seen[some[r], cells.group[own[v][c]]] = True
                if first:
                    row, g = np.nonzero(seen)
                    g = g << 20
                else:
                    row, found = np.nonzero(seen)
                    times = parts[found]
                    row, g = np.repeat(row, times), (np.repeat(found, times) << 20) + np.concatenate([np.arange(t) for t in times] or [[]]).astype(int)
                    new = g != b.column("done").to_numpy()[row]
                    row, g = row[new], g[new]
                some = b.select(["id", "vector", "same", "other"]).take(pa.array(row))
                beat = np.full(len(row), -np.inf) if first else least[row]
                yield pa.RecordBatch.from_arrays([pa.array(g), *some.columns, pa.array(beat)], ["g", "id", "vector", "same", "other", "least"])

    return queries.mapInArrow(go, f"g long, id long, vector {kind}, same string, other string, least double")


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts, alike on both sides; -1 for null."""
    codes = pd.factorize(pd.concat([a.to_pandas(), b.to_pandas()], ignore_index=True))[0]
    return codes[: len(a)], codes[len(a) :]


def _search(cells: Cells, k: int, same: bool, other: bool, itself: bool, later: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best k items of a group for each query that came to it."""
    dim = cells.centres.shape[1]
    sign = -1 if later else 1

    def go(items: pa.Table, queries: pa.Table) -> pa.Table:
        x, q = _matrix(items["vector"], dim), _matrix(queries["vector"], dim)
        ids, asking, least = items["id"].to_numpy(), queries["id"].to_numpy(), queries["least"].to_numpy().copy()
        (s_i, s_q), (o_i, o_q) = _codes(items["same"], queries["same"]), _codes(items["other"], queries["other"])
        out: list[np.ndarray] = []
        if len(x) and len(q):
            cell = np.searchsorted(cells.number, items["cell"].to_numpy())
            # of equal vectors with equal labels the first k + 1 ids are enough, however many there are
            rows = pd.DataFrame({"v": [r.tobytes() for r in x], "s": s_i, "o": o_i, "id": sign * ids, "cell": cell, "at": np.arange(len(x))}).sort_values("id", kind="stable")
            rows = rows[rows.groupby(["v", "s", "o"]).cumcount() <= k].sort_values(["cell", "id"], kind="stable")
            at, starts = rows["at"].to_numpy(), np.flatnonzero(np.diff(rows["cell"].to_numpy(), prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], len(at)], strict=True):
                mine, c = at[lo:hi], cell[at[lo]]
                one = Cells(*(f[c : c + 1] for f in cells))
                for b in range(0, len(q), step := max(1, SCORES // len(mine))):
                    block = np.arange(b, min(b + step, len(q)))
                    block = block[bounds(q[block], one)[:, 0] >= least[block]]
                    if not len(block):
                        continue
                    score = q[block] @ x[mine].T
                    # what has a score to beat beats it seldom: only such items are looked at closer, unless they are many
                    if least[block].min() > -np.inf and np.count_nonzero(over := score >= (least[block] - SLACK * (1 + np.abs(least[block])))[:, None]) <= k * len(block):
                        r, i = np.nonzero(over)
                        value, a, c_i = np.round(score[r, i], DIGITS), block[r], mine[i]
                        fit = value >= least[a]
                        if same:
                            fit &= (s_q[a] == s_i[c_i]) & (s_q[a] >= 0)
                        if other:
                            fit &= (o_q[a] != o_i[c_i]) | (o_q[a] < 0)
                        if not itself:
                            fit &= asking[a] != ids[c_i]
                        out.append(np.rec.fromarrays([a[fit], -value[fit], sign * ids[c_i[fit]]], names="q,s,i"))
                        continue
                    score = np.round(score, DIGITS)
                    if same:
                        score[(s_q[block][:, None] != s_i[mine][None]) | (s_q[block][:, None] < 0)] = -np.inf
                    if other:
                        score[(o_q[block][:, None] == o_i[mine][None]) & (o_q[block][:, None] >= 0)] = -np.inf
                    if not itself:
                        score[asking[block][:, None] == ids[mine][None]] = -np.inf
                    if len(mine) > k:  # the k-th best of a cell is no better than that of all
                        least[block] = np.maximum(least[block], np.partition(score, len(mine) - k, 1)[:, len(mine) - k])
                    r, i = np.nonzero((score >= least[block][:, None]) & (score > -np.inf))
                    out.append(np.rec.fromarrays([block[r], -score[r, i], sign * ids[mine[i]]], names="q,s,i"))
        if not out:
            return pa.table({"query_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = np.concatenate(out)
        found = found[np.lexsort([found["i"], found["s"], found["q"]])]
        rank = np.arange(len(found)) - np.maximum.accumulate(np.where(np.diff(found["q"], prepend=-1) != 0, np.arange(len(found)), 0))
        found = found[rank < k]
        return pa.table({"query_id": asking[found["q"]], "item_id": sign * found["i"], "score": -found["s"]})

    return go


def _met(items: DataFrame, routes: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], size: int) -> DataFrame:
    """All routes searched: a group's queries are cut into shares of bounded bytes, and the group goes to each share."""
    loads = routes.groupBy("g").agg(F.ceil(F.count(F.lit(1)) * size / QUERY_BYTES).alias("shares"))
    left = items.join(loads, "g").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    right = routes.join(loads, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("shares"))).drop("shares")
    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(lambda a, b: search(a, b), "query_id long, item_id long, score double")


def nearest(
    queries: DataFrame, items: DataFrame, k: int = 5, same: Sequence[str] = (), other: Sequence[str] = (), least: float | None = None, itself: bool = False, later: bool = False, dim: int | None = None,
) -> DataFrame:
    """(query_id, item_id, score, rank): the k items of each query with the largest inner products, exactly.

    ``queries``: (query_id, vector), ``items``: (item_id, vector), with whole numbers as ids and whatever other columns.
    An item counts for a query only where the columns ``same`` are equal and not null on both sides and the columns
    ``other`` aren't equal (nulls differ from all), where it has another id unless ``itself``, and where its score is
    ``least`` or more. Scores are rounded to 12 digits; ties go to the smaller id, or with ``later`` to the larger.

    Vectors count where they have the length ``dim``, by default the most frequent one of the items, and only finite
    entries; rows without an id are left out. A query without a counting item has no row. Repeated ids are items of
    their own, and equal ones tie. Tasks hold a group of items and a share of its queries, both of bounded bytes.
    """
    spark = items.sparkSession
    checkpoints(spark)
    empty = spark.createDataFrame([], "query_id long, item_id long, score double, rank int")
    dim = dim or length_of(items)
    if not dim:
        return empty
    wanted, there = usable(queries, "query_id", dim, same, other), usable(items, "item_id", dim, same, other)
    if same:  # others meet nothing
        wanted, there = wanted.where("same IS NOT NULL"), there.where("same IS NOT NULL")
    wanted, there = wanted.withColumn("bucket", _bucket(same)), there.withColumn("bucket", _bucket(same))
    held = {r.bucket: r["count"] for r in there.groupBy("bucket").count().collect()}  # BUCKETS rows at most
    known = np.array(sorted(held), np.int64)
    some = max(1, min(int(sum(held.values()) ** 0.5), CENTRE_BYTES // (8 * dim * max(1, len(known)))))
    picked = there.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(some).toArrow()
    if not picked.num_rows:
        return empty
    centres = _matrix(picked["vector"], dim)
    dealt = _dealt(there, centres, known).checkpoint()
    cells = _cells(dealt, centres, known)
    group, parts = (np.zeros(len(centres) * len(known), int) for _ in "gp")
    group[cells.number], parts[cells.number] = cells.group << 20, cells.parts
    of = lambda values: F.element_at(F.lit(values.tolist()), F.col("cell") + 1).cast("long")
    placed = dealt.withColumn("g", of(group) + F.pmod(F.xxhash64("id", "vector"), of(parts))).select("g", "id", "vector", "same", "other", "cell")
    search = _search(cells, k, bool(same), bool(other), itself, later)
    routes = _routes(wanted, cells, True).checkpoint()
    known = _met(placed, routes, search, 8 * dim).checkpoint()
    floor = float("-inf") if least is None else least
    best = known.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(floor).alias("least"))
    asked = routes.select("id", "vector", "same", "other", F.col("g").alias("done")).join(best.withColumnRenamed("query_id", "id"), "id", "left")
    asked = asked.withColumn("least", F.greatest(F.coalesce("least", F.lit(floor)), F.lit(floor)))
    more = _met(placed, _routes(asked.withColumn("bucket", _bucket(same)), cells, False).checkpoint(), search, 8 * dim)
    tie = F.col("item_id").desc() if later else F.col("item_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), tie))
    return known.unionByName(more).where(F.col("score") >= floor).withColumn("rank", rank).where(F.col("rank") <= k)


def candidates(statements: DataFrame, index: TermIndex, k: int = 5, same: Sequence[str] = (), other: Sequence[str] = (), most: int = 20, duplicate: float = S.REUSE_COSINE) -> DataFrame:
    """(item_a, item_b, by_vector, by_terms, score, weight, relation), a row a pair, of statements that may make a question together.

    ``statements``: (item_id, vector, text, kind, ...); ``index`` holds their texts. Each statement proposes its k nearest
    by vector and the k that share most of its distinctive terms, both among those that ``same`` and ``other`` allow, so
    there are at most 2 k pairs a statement. A pair is a ``duplicate`` where its inner product reaches ``duplicate`` or
    the statements' keys are equal, ``complementary`` where its types go together, else ``related``. ``score`` and
    ``weight`` are null where a pair lacks a vector or shares no distinctive term with a place among the best.
    """
    checkpoints(statements.sparkSession)
    near = nearest(statements.withColumnRenamed("item_id", "query_id"), statements, k, same, other).select("query_id", "item_id", F.lit(True).alias("v"), F.lit(None).cast("double").alias("weight"))
    words = shared_terms(index, k, most, statements, same, other).select("query_id", "item_id", F.lit(False).alias("v"), "weight")
    ends = F.least("query_id", "item_id").alias("item_a"), F.greatest("query_id", "item_id").alias("item_b")
    pairs = near.unionByName(words).groupBy(*ends).agg(F.bool_or("v").alias("by_vector"), F.bool_or(~F.col("v")).alias("by_terms"), F.max("weight").alias("weight")).checkpoint()
    side = lambda s: statements.select(F.col("item_id").alias(f"item_{s}"), F.col("vector").alias(f"v_{s}"), statement_key(F.col("text")).alias(f"key_{s}"), F.col("kind").alias(f"kind_{s}"))
    both = pairs.join(side("a"), "item_a").join(side("b"), "item_b")
    score = F.round(F.when(F.size("v_a") == F.size("v_b"), dot(F.col("v_a"), F.col("v_b"))), DIGITS)
    alike = F.coalesce(score >= duplicate, F.lit(False)) | ((F.col("key_a") == F.col("key_b")) & (F.col("key_a") != ""))
    kinds = F.concat_ws("+", F.array_sort(F.array("kind_a", "kind_b")))
    relation = F.when(alike, "duplicate").when(kinds.isin(["+".join(sorted(p)) for p in S.COMPLEMENTS]), "complementary").otherwise("related")
    return both.select("item_a", "item_b", "by_vector", "by_terms", score.alias("score"), "weight", relation.alias("relation"))
