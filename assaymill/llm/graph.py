"""Connected components of an edge table by alternating stars, without any vertex's neighbours in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): the smallest id that its links reach.

    Each round hangs every vertex on the smallest vertex it knows of, first for larger, then for smaller
    neighbours, until nothing changes; rounds grow as the logarithm of the longest path. Minima are
    pre-aggregated before the shuffle, so hubs do no harm.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        now = stored(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    hung = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = now.select(F.col("v").alias("id")).distinct()
    return hung.unionByName(roots.select("id", F.col("id").alias("component")).join(hung.select("id"), "id", "left_anti"))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that join what the links join, one fewer than the members of each component at most."""
    n, m = linked.shape
    rows, columns, edges = np.zeros(n, bool), np.zeros(m, bool), []
    for r in np.flatnonzero(linked.any(1)):
        if rows[r]:
            continue
        rows[r], queue = True, [int(r)]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(linked[x] & ~columns)
            columns[new] = True
            edges += [(x, int(c)) for c in new]
            for c in new:
                more = np.flatnonzero(linked[:, c] & ~rows)
                rows[more] = True
                edges += [(int(y), int(c)) for y in more]
                queue += more.tolist()
    return edges
