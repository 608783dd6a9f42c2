"""Exact near duplicates of vectors: cover trees of bounded parts, traversed in pairs with covering-radius bounds.

Equal vectors of one label are one class with a count. The classes of a label, ordered by the nearest of a few
sampled centres and by their distance to it, are dealt into parts of bounded bytes, each a cover tree: nested
levels of nodes with halving radii, every point within the radius of its node, the points in the trees' order, so
that each node is a stretch of points. Two parts of a label are compared unless the distance of the roots, less
both covering radii, exceeds the threshold. A pair of trees is traversed in blocks of neighbouring nodes: at each
level the columns that the bound excludes for the whole block are dropped before anything below them is computed,
node pairs whose widest members must link are counted whole, and what is left at the points is compared in double
precision. Distances only prune; a link is decided by the cosine itself. The sampled centres decide the order of
the points alone.

Null labels, null, empty and zero vectors and vectors with null or non-finite parts link with nothing;
vectors of different length link with nothing either. Equal vectors link with each other. Repeated rows
of one vec_id are vectors of their own, linked only where they are near each other; null ids link with nothing.
An empty table gives no rows; only the three columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, run_folder, spread, stored
from .graph import components, forest

#: Bytes of a part's vectors at most, which bounds what a task holds, and classes that a part may have at least.
PART_BYTES, PART_LEAST = 8 << 20, 256
#: Pairs of a part that one task compares, roots that are broadcast at most, and sampled centres for each length.
PAIRS_AT_ONCE, ROOTS_AT_ONCE, CENTRES = 16, 20_000, 64
#: Radii of the levels below the root.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Nodes of a block, and columns whose cosines are computed together.
BLOCK, COLUMNS = 512, 8192
#: What rounding may shift a distance by.
SLACK = 1e-7


def unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """The centre of each point: point 0 is one, and every point that no centre before it is within the radius of."""
    n, centres, owner = len(points), [0], np.zeros(len(points), np.int64)
    for at in range(0, n, BLOCK):
        some = points[at : at + BLOCK]
        far, near = np.full(len(some), np.inf), np.zeros(len(some), np.int64)
        for c in range(0, len(centres), COLUMNS):
            d = distances(some, points[centres[c : c + COLUMNS]])
            best = d.argmin(1)
            least = d[np.arange(len(some)), best]
            near, far = np.where(least < far, best + c, near), np.minimum(least, far)
        among = distances(some, some)
        for i in np.flatnonzero(far > radius):
            if far[i] > radius:
                closer = among[i] < far
                closer[i] = True
                near[closer], far[closer] = len(centres), among[i][closer]
                far[i] = 0
                centres.append(at + int(i))
        owner[at : at + BLOCK] = near
        if at == 0 and n > 2 * BLOCK and len(centres) > 3 * BLOCK // 4:
            return np.arange(n)  # hardly a node has company
    return np.array(centres)[owner]


class CoverTree:
    """``order`` puts the points in the tree's order; a level is (centres, starts, covering radii) of its nodes.

    A node of level l holds the points from its start to the next one's; level 0 is the root, the last one the points.
    """

    def __init__(self, points: np.ndarray):
        n, self.order = len(points), np.arange(len(points))
        centre, levels = np.zeros(n, np.int64), [np.zeros(n, np.int64)]  # of each point, as places in ``points``
        for radius in RADII:
            new = np.empty(n, np.int64)
            for c, members in _groups(centre):
                members = np.concatenate([[c], members[members != c]])  # a node's centre stays one below it
                new[members] = members[net(points[members], radius)]
            kinds = len(np.unique(new))
            if kinds > 3 * n // 4:
                break
            if kinds > len(np.unique(centre)):
                levels.append(new)
                centre = new
        self.order = np.lexsort(levels[::-1])
        self.points, back = points[self.order], np.empty(n, np.int64)
        back[self.order] = np.arange(n)
        self.levels = []
        for owner in levels:
            of = owner[self.order]
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if n else np.empty(0, np.int64)
            centres = back[of[starts]]
            size = np.diff(np.append(starts, n))
            far = np.sqrt(np.maximum(2 - 2 * (self.points * self.points[np.repeat(centres, size)]).sum(1), 0))
            self.levels.append((centres, starts, np.maximum.reduceat(far, starts) if n else far))
        self.levels.append((np.arange(n), np.arange(n), np.zeros(n)))


def _groups(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    by = np.argsort(owner, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], owner[by][1:] != owner[by][:-1]]))
    for i, j in zip(first, np.append(first[1:], len(by)), strict=True):
        yield int(owner[by[i]]), by[i:j]


class Pair:
    """The links between the points of two trees, or inside one: their numbers, and edges that join what they join.

    ``tests`` counts the distances and cosines that were computed.
    """

    def __init__(self, a: CoverTree, b: CoverTree, weights_a: np.ndarray, weights_b: np.ndarray, threshold: float):
        self.trees, self.weights, self.threshold, self.same = (a, b), (weights_a, weights_b), threshold, a is b
        self.reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
        self.counts = [np.zeros(len(a.points), np.int64), np.zeros(len(b.points), np.int64)]
        if self.same:
            self.counts[1] = self.counts[0]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.tests = 0
        if len(a.points) and len(b.points):
            self._blocks(0, 0, 1, np.zeros(1, np.int64))

    def _level(self, side: int, level: int) -> int:
        """The shorter tree waits above its points until the longer one comes to its own."""
        own, depth = len(self.trees[side].levels), max(len(t.levels) for t in self.trees)
        return own - 1 if level == depth - 1 else min(level, own - 2)

    def _span(self, side: int, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, exclusive, of the nodes' points."""
        starts = np.append(self.trees[side].levels[level][1], len(self.trees[side].points))
        return starts[nodes], starts[nodes + 1]

    def _below(self, side: int, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parent's place in ``nodes``, child) of the next level."""
        here, down = self._level(side, level), self._level(side, level + 1)
        if here == down:
            return np.arange(len(nodes)), nodes
        first, last = self._span(side, here, nodes)
        starts = self.trees[side].levels[down][1]
        lo, hi = np.searchsorted(starts, first), np.searchsorted(starts, last)
        n = hi - lo
        return np.repeat(np.arange(len(nodes)), n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())

    def _blocks(self, level: int, first: int, last: int, columns: np.ndarray) -> None:
        """Compare a block of neighbouring nodes of one tree with some nodes of the other, then what is below."""
        i, j = self._level(0, level), self._level(1, level)
        (a, b), depth = self.trees, max(len(t.levels) for t in self.trees)
        rows = np.arange(first, last)
        if self.same:
            columns = columns[columns >= first]
        if level == depth - 1:
            for c in range(0, len(columns), COLUMNS):
                self._points(first, last, columns[c : c + COLUMNS])
            return
        live, whole = (np.zeros((len(rows), len(columns)), bool) for _ in range(2))
        for c in range(0, len(columns), COLUMNS):
            some = columns[c : c + COLUMNS]
            gap = distances(a.points[a.levels[i][0][rows]], b.points[b.levels[j][0][some]])
            self.tests += gap.size
            wide = a.levels[i][2][rows][:, None] + b.levels[j][2][some]
            whole[:, c : c + COLUMNS] = gap + wide <= self.reach - 3 * SLACK
            live[:, c : c + COLUMNS] = gap <= self.reach + wide + SLACK
        parent, child = self._below(0, level, rows)
        below = self._level(0, level + 1)
        for at in range(0, len(child), BLOCK):
            block, above = child[at : at + BLOCK], np.unique(parent[at : at + BLOCK])
            linked = whole[above].all(0)
            if self.same:  # among the block's own nodes all or none, for both directions are counted at one level
                own = (columns >= rows[above[0]]) & (columns <= rows[above[-1]])
                linked &= ~own | linked[own].all()
            if linked.any():
                starts, ends = self._span(0, below, block)
                self._whole(int(starts[0]), int(ends[-1]), *self._span(1, j, columns[linked]))
            hit = live[above].any(0) & ~linked
            if hit.any():
                self._blocks(level + 1, int(block[0]), int(block[-1]) + 1, self._below(1, level, columns[hit])[1])

    def _whole(self, first: int, last: int, starts: np.ndarray, ends: np.ndarray) -> None:
        """All points of a stretch link with all points of some others; inside one tree only with those from its start on."""
        if self.same:
            starts = np.maximum(starts, first)
            starts, ends = starts[starts < ends], ends[starts < ends]
            if not len(starts):
                return
        size = ends - starts
        columns = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.counts[0][first:last] += self.weights[1][columns].sum()
        inside = columns < last if self.same else np.zeros(len(columns), bool)
        self.counts[1][columns[~inside]] += self.weights[0][first:last].sum()
        self.counts[0][columns[inside]] -= self.weights[0][columns[inside]]  # a vector isn't linked with itself
        self.edges.append((np.arange(first, last), np.full(last - first, columns[0])))
        self.edges.append((np.full(len(columns), first), columns))

    def _points(self, first: int, last: int, columns: np.ndarray) -> None:
        linked = self.trees[0].points[first:last] @ self.trees[1].points[columns].T >= self.threshold
        self.tests += linked.size
        rows = np.arange(first, last)
        if self.same:
            linked &= rows[:, None] != columns
        if not linked.any():
            return
        self.counts[0][first:last] += linked @ self.weights[1][columns]
        later = columns >= last if self.same else np.ones(len(columns), bool)
        self.counts[1][columns[later]] += linked[:, later].T @ self.weights[0][first:last]
        edges = np.array(forest(linked), np.int64).reshape(-1, 2)
        self.edges.append((rows[edges[:, 0]], columns[edges[:, 1]]))


def vectors_of(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the rows of one length at a time, without null, empty, zero and non-finite ones."""
    column = column.cast(pa.large_list(column.type.value_type))
    at, values = column.offsets.to_numpy(), column.values
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    if values.null_count:
        gone = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        size[gone[at[1:]] > gone[at[:-1]]] = 0
        values = values.fill_null(0)
    flat = values.to_numpy(zero_copy_only=False).astype(kind)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        x = flat[at[rows][:, None] + np.arange(n)]
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((x.astype(float) ** 2).sum(1))
        good = (norm > 0) & np.isfinite(norm)
        yield rows[good], x[good]


def sampled(rows: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """At most CENTRES vectors of each of the CENTRES commonest lengths, those of the smallest hashes: bounded at any size."""
    hashed = rows.where("v IS NOT NULL AND id IS NOT NULL").select(F.size("v").alias("dim"), "v", F.xxhash64("id").alias("h"))
    out = {}
    for r in hashed.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(CENTRES).collect():
        some = hashed.where(F.col("dim") == r.dim).orderBy("h").limit(CENTRES).select("v").toArrow().column(0).combine_chunks()
        for _, x in vectors_of(some, kind):
            x = unit(x.astype(float))
            chain, left = [0], set(range(1, len(x)))
            while left:  # near centres get near places
                chain.append(max(left, key=lambda i: x[i] @ x[chain[-1]]))
                left.discard(chain[-1])
            out[x.shape[1]] = x[chain]
    return out


def checked(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, raw vector or null where it links with nothing, its place: nearest centre and distance to it)."""
    kind = kind_of(vectors, vector)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    centres = sampled(rows, kind)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, place = np.full(b.num_rows, None, object), np.zeros(b.num_rows)
            for at, x in vectors_of(b.column(2), kind):
                raw[at] = [v.tobytes() for v in x]
                if x.shape[1] in centres:
                    d = distances(unit(x.astype(float)), centres[x.shape[1]])
                    place[at] = 4.0 * d.argmin(1) + d.min(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(place)], names=["id", "label", "raw", "place"])

    made = rows.mapInArrow(go, "id long, label string, raw binary, place double")
    return made.withColumn("raw", F.when(F.col("label").isNotNull() & F.col("id").isNotNull(), F.col("raw")))


def kind_of(vectors: DataFrame, vector: str) -> str:
    return "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"


def parts_of(classes: DataFrame, kind: str) -> DataFrame:
    """Runs of classes of one label and length, near each other: a row per run with its ids, counts and vectors in the
    order of its cover tree, the tree, root and covering radius. A label of any size is dealt over many tasks."""
    spark, width = classes.sparkSession, np.dtype(kind).itemsize

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, left = TaskContext.get().partitionId(), 0, None

        def part(x: pd.DataFrame) -> dict:
            nonlocal made
            raw = np.stack([np.frombuffer(r, kind) for r in x.raw])
            tree = CoverTree(unit(raw.astype(float)))
            made += 1
            return {
                "part": task * 10**9 + made, "label": x.label.iloc[0], "dim": raw.shape[1], "ids": x.id.to_numpy()[tree.order], "counts": x.n.to_numpy()[tree.order],
                "vectors": raw[tree.order].tobytes(), "tree": pickle.dumps(tree.levels), "root": tree.points[tree.levels[0][0][0]], "radius": float(tree.levels[0][2][0]),
            }

        def runs(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
            new = (x.label != x.label.shift()) | (x.dim != x.dim.shift())
            for _, run in x.groupby(new.cumsum(), sort=False):
                most = max(PART_LEAST, PART_BYTES // int(run.dim.iloc[0]))
                for i in range(0, len(run), most):
                    yield run.iloc[i : i + most]

        for b in batches:
            b = pd.concat([left, b]) if left is not None else b
            *whole, left = runs(b) if len(b) else [None]
            for x in whole:
                yield pd.DataFrame([part(x)])
        if left is not None:
            yield pd.DataFrame([part(left)])

    schema = "part long, label string, dim int, ids array<long>, counts array<long>, vectors binary, tree binary, root array<double>, radius double"
    sized = classes.withColumn("dim", F.octet_length("raw"))
    total = sized.agg(F.sum("dim")).first()[0] or 0
    tasks = int(min(spread(spark), 1 + 4 * total // PART_BYTES))  # few rows stay in few parts
    ordered = sized.repartitionByRange(tasks, "label", "dim", "place", "id").sortWithinPartitions("label", "dim", "place", "id")
    return stored(ordered.mapInPandas(go, schema), "vector-parts")


def part_pairs(parts: DataFrame, threshold: float) -> DataFrame:
    """(part_a, part_b), part_a <= part_b, of one label that roots and covering radii don't rule out."""
    reach = float(np.sqrt(2 - 2 * threshold)) + 2 * SLACK
    one, other = (parts.select(*[F.col(c).alias(f"{c}_{s}") for c in ("part", "label", "dim", "root", "radius")]) for s in "ab")
    cosine = F.aggregate(F.zip_with("root_a", "root_b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    near = F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))) <= F.col("radius_a") + F.col("radius_b") + reach
    n = parts.count()
    other = F.broadcast(other) if n <= ROOTS_AT_ONCE else other
    pairs = one.repartition(spread(parts.sparkSession), "part_a").join(other, (F.col("label_a") == F.col("label_b")) & (F.col("dim_a") == F.col("dim_b")) & (F.col("part_a") <= F.col("part_b")))
    return stored(pairs.withColumn("cosine", cosine).where(near | (F.col("part_a") == F.col("part_b"))).select("part_a", "part_b"), "part-pairs")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    with run_folder(vectors.sparkSession, "embeddings"):
        return kept(_joined(vectors, threshold, key, vector, label), "near-vectors")


def _joined(vectors: DataFrame, threshold: float, key: str, vector: str, label: str) -> DataFrame:
    spark, kind = vectors.sparkSession, kind_of(vectors, vector)
    rows = stored(checked(vectors, key, vector, label), "vectors")
    good = rows.where("raw IS NOT NULL")
    classes = stored(good.groupBy("label", "raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.min("place").alias("place")), "vector-classes")
    classes = stored(classes.withColumnRenamed("id", "vec").withColumn("id", F.monotonically_increasing_id()), "numbered-classes")
    parts = parts_of(classes, kind)
    pairs = part_pairs(parts, threshold)
    # a part's pairs go in groups, each with a row of the part itself first
    groups = pairs.groupBy("part_a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_AT_ONCE).alias("groups"))
    dealt = pairs.join(groups, "part_a").withColumn("group", F.pmod(F.xxhash64("part_b"), F.col("groups")))
    hosts = dealt.select("part_a", "group").distinct().select("part_a", "group", F.col("part_a").alias("part_b"), F.lit(False).alias("guest"))
    wanted = dealt.select("part_a", "group", "part_b", F.lit(True).alias("guest")).unionByName(hosts)
    held = parts.select(F.col("part").alias("part_b"), "dim", "ids", "counts", "vectors", "tree")
    loaded = wanted.join(held, "part_b").repartition(spread(spark), "part_a", "group").sortWithinPartitions("part_a", "group", "guest", "part_b")

    def tree_of(r: dict) -> CoverTree:
        tree = CoverTree.__new__(CoverTree)
        tree.points = unit(np.frombuffer(r["vectors"], kind).reshape(len(r["ids"]), -1).astype(float))
        tree.levels = pickle.loads(r["tree"])
        return tree

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in ("part_a", "part_b", "guest", "vectors", "tree")}
                r = {k: v.as_py() for k, v in r.items()} | {c: b.column(c)[i].values.to_numpy() for c in ("ids", "counts")}
                if not r["guest"]:
                    host = r["part_a"], tree_of(r), r["ids"], r["counts"]
                    continue
                _, a, ids_a, n_a = host
                same = r["part_b"] == host[0]
                found = Pair(a, a if same else tree_of(r), n_a, r["counts"], threshold)
                ids_b = r["ids"]
                ids = ids_a if same else np.concatenate([ids_a, ids_b])
                n = found.counts[0] if same else np.concatenate(found.counts)
                x, y = (np.concatenate([e[k] for e in found.edges]) if found.edges else np.empty(0, np.int64) for k in (0, 1))
                columns = [
                    pa.array(np.concatenate([ids[n > 0], ids_a[x]])), pa.array([None] * int((n > 0).sum()) + ids_b[y].tolist(), pa.int64()),
                    pa.array(np.concatenate([n[n > 0], np.zeros(len(x), np.int64)])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

    found = stored(loaded.mapInArrow(compare, "a long, b long, n long"), "vector-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    joined = components(found.where("b IS NOT NULL AND a <> b").select("a", "b")).withColumnRenamed("id", "class")
    of = classes.select("label", "raw", F.col("id").alias("class"), "vec", "n").join(links, "class", "left").join(joined, "class", "left")
    of = of.withColumn("component", F.coalesce("component", "class"))
    of = of.join(of.groupBy("component").agg(F.min("vec").alias("least")), "component")
    out = rows.select("id", "label", "raw").join(of, ["label", "raw"], "left")
    component = F.coalesce("least", "id")
    return out.select(
        F.col("id").alias("vec_id"), (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
