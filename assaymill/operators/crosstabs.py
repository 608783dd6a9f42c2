"""Distributions over several dimensions at once, with all their margins, in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands for a null value, and for all values of a dimension.
NONE, ALL = "none", "all"


def crosstab(rows: DataFrame, dims: Sequence[str], distinct: Sequence[str] = (), sets: Sequence[Sequence[str]] | None = None, measures: dict[str, Column] | None = None) -> DataFrame:
    """(dims..., level, n, share, distinct_..., measures...): counts for every combination of the dimensions and every margin.

    ``level`` has a bit for each dimension that is summed over, the first dimension the highest; its name is ``all`` there.
    ``share`` is the part of the rows that have the same values in all dimensions but the last one that isn't summed over,
    so that shares of the innermost dimension add up to one. ``sets`` names the combinations that are wanted, by default all.
    Nulls count as ``none``. Distinct counts are exact, also where rows are spread.
    """
    named = rows.select(*[F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in dims], *[c for c in rows.columns if c not in dims])
    grouped = named.cube(*dims) if sets is None else named.groupingSets([[F.col(c) for c in s] for s in sets], *dims)
    made = [F.countDistinct(c).alias(f"distinct_{c}") for c in distinct] + [c.alias(n) for n, c in (measures or {}).items()]
    out = grouped.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), *made)
    bit = lambda i: F.col("level").bitwiseAND(F.lit(1 << (len(dims) - 1 - i))) > 0
    out = out.select(*[F.when(bit(i), ALL).otherwise(F.col(d)).alias(d) for i, d in enumerate(dims)], *[c for c in out.columns if c not in dims])
    last = reduce(lambda acc, i: F.when(~bit(i), i).otherwise(acc), range(len(dims)), F.lit(-1))  # the last dimension that isn't summed over
    outer = [F.when(last == i, F.lit("")).otherwise(F.col(d)) for i, d in enumerate(dims)]
    total = F.sum("n").over(Window.partitionBy("level", *outer))
    return out.withColumn("share", F.round(F.col("n") / total, 6))


def concentration(table: DataFrame, dim: str, of: str, value: str) -> DataFrame:
    """(of, share, risk) from a crosstab: how much of ``of`` has the given value of ``dim``; ``risk`` where that is more than half."""
    rows = table.where((F.col(dim) == value) & (F.col(of) != ALL))
    both = table.where((F.col(dim) == ALL) & (F.col(of) != ALL)).groupBy(of).agg(F.max("n").alias("_all"))
    found = both.join(rows.groupBy(of).agg(F.max("n").alias("_some")), of, "left")
    share = F.round(F.coalesce("_some", F.lit(0)) / F.col("_all"), 6)
    return found.select(of, share.alias("share"), (share > 0.5).alias("risk"))
