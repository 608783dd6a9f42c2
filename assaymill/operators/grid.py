"""A table as a grid: filters on any column, order by several, pages by the last row seen, statistics of all that is filtered."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.operators.cases import numbered
from assaymill.operators.crosstabs import crosstab

#: A condition is (column, test, value); an order is (column, ascending).
Condition = tuple[str, str, Any]
Order = tuple[str, bool]


def condition(column: str, test: str, value: Any) -> Column:
    """``contains`` (a text, whatever its case), ``in`` (a list, of which null may be one), ``between`` (two ends, either of which may be None), ``is`` (equal, null-safe), ``blank``."""
    c = F.col(column)
    if test == "contains":
        return F.contains(F.lower(c.cast("string")), F.lit(str(value).lower()))
    if test == "in":
        some = [v for v in value if v is not None]
        return F.coalesce(c.isin(some), F.lit(False)) | (c.isNull() if len(some) < len(list(value)) else F.lit(False))
    if test == "between":
        low, high = value
        return (F.lit(True) if low is None else c >= F.lit(low)) & (F.lit(True) if high is None else c <= F.lit(high)) & c.isNotNull()
    if test == "is":
        return c.eqNullSafe(F.lit(value))
    if test == "blank":
        return (F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "") == F.lit(bool(value))
    raise ValueError(f"unknown test {test}")


def filtered(rows: DataFrame, conditions: Iterable[Condition]) -> DataFrame:
    """Rows that meet all conditions; simple ones reach the scan."""
    return reduce(lambda df, c: df.where(condition(*c)), conditions, rows)


def _sorted(order: Sequence[Order], key: str) -> list[Column]:
    return [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in (*order, (key, True))]


def beyond(order: Sequence[Order], key: str, last: Sequence[Any]) -> Column:
    """Whether a row comes after the row with the values ``last`` (one for each column of the order, then the key). Nulls come first upwards and last downwards."""
    columns = [*order, (key, True)]
    out, same = F.lit(False), F.lit(True)
    for (name, up), value in zip(columns, last, strict=True):
        c = F.col(name)
        if value is None:
            after = c.isNotNull() if up else F.lit(False)
        else:
            after = F.coalesce(c > F.lit(value), F.lit(False)) if up else (c.isNull() | F.coalesce(c < F.lit(value), F.lit(False)))
        out, same = out | (same & after), same & c.eqNullSafe(F.lit(value))
    return out


def page(rows: DataFrame, order: Sequence[Order], key: str, size: int = 50, after: Sequence[Any] | None = None) -> DataFrame:
    """The next ``size`` rows after the row with the values ``after``, or the first ones. Each task keeps ``size`` rows; nothing is skipped over."""
    left = rows if after is None else rows.where(beyond(order, key, after))
    return left.orderBy(*_sorted(order, key)).limit(size)


def pages(rows: DataFrame, order: Sequence[Order], key: str, size: int = 50) -> DataFrame:
    """The rows with ``place`` and ``page``, from 1: all pages at once, numbered over sorted ranges, so no task sorts all rows. Keys must not repeat."""
    out = numbered(rows, "place", *_sorted(order, key))
    return out.withColumn("page", F.floor((F.col("place") - 1) / size) + 1)


def cursors(paged: DataFrame, order: Sequence[Order], key: str) -> DataFrame:
    """(page, rows, order..., key): the last row of each page, which gives the next one by ``page(after=...)`` without those before."""
    last = F.max_by(F.struct(*[c for c, _ in order], key), "place").alias("last")
    return paged.groupBy("page").agg(F.count(F.lit(1)).alias("rows"), last).select("page", "rows", "last.*")


def statistics(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dim, value, n, share) of every dimension and of all rows (dim ``all``), over the filtered rows and not a page of them, in one scan."""
    table = crosstab(rows, list(dims), sets=[*[[d] for d in dims], []])
    names = F.array(*map(F.lit, dims)) if dims else F.array().cast("array<string>")
    values = F.array(*map(F.col, dims)) if dims else F.array().cast("array<string>")
    bits = [F.col("level").bitwiseAND(F.lit(1 << (len(dims) - 1 - i))) == 0 for i in range(len(dims))]
    at = reduce(lambda acc, i: F.when(bits[i], i + 1).otherwise(acc), range(len(dims)), F.lit(0))
    out = table.withColumn("_at", at).where((F.col("_at") > 0) | (F.col("n") > 0))
    return out.select(F.when(F.col("_at") == 0, "all").otherwise(F.try_element_at(names, F.col("_at"))).alias("dim"), F.when(F.col("_at") == 0, "all").otherwise(F.try_element_at(values, F.col("_at"))).alias("value"), "n", "share")
