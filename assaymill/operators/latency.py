"""Latency percentiles from sketches that are stored once and merged for any grouping, without the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a sketch keeps at most, about; fewer rows than that are kept whole, and percentiles of them are exact.
KEPT = 800
#: Beyond that, how far the rank of a percentile may be off, as a share of the rows, in 99 of 100 cases.
RANK_ERROR = 0.0055
POINTS = (0.5, 0.95)


def sketched(results: DataFrame, by: Sequence[str] = ("run_id", "dimension"), value: str = "latency_ms", time: str | None = "ts", grain: str = "hour") -> DataFrame:
    """(by..., period, n, total, least, most, sketch): one row for each combination and period, to be stored.

    Null and NaN values aren't measured and don't count; null columns are values like others. Without ``time`` there is no period.
    """
    rows = results.withColumn("_v", F.col(value).cast("double")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    period = [F.date_trunc(grain, F.col(time).cast("timestamp")).alias("period")] if time else []
    sketch = F.kll_sketch_agg_double("_v", F.lit(KEPT)).alias("sketch")
    return rows.groupBy(*by, *period).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"), sketch)


def rolled_up(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same over fewer columns: only sketches are read, whatever they stand for."""
    merged = F.kll_merge_agg_double("sketch", F.lit(KEPT)).alias("sketch")
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), merged)


def percentiles(sketches: DataFrame, points: Sequence[float] = POINTS) -> DataFrame:
    """Adds ``mean`` and, for each point, a column such as ``p50`` or ``p95``: the least value that so many of the rows don't exceed."""
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in points]))
    out = sketches.withColumn("_q", found).withColumn("mean", F.col("total") / F.col("n"))
    return out.withColumns({f"p{p * 100:g}".replace(".", "_"): F.col("_q")[i] for i, p in enumerate(points)}).drop("_q", "sketch", "total")
