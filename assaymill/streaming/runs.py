"""Extension: running pass rates of evaluation results that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill import schemas as S


def passes_by_window(results: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, dimension, total, passed): results by window and dimension; rows later than ``late`` are dropped once
    their window is closed, and the state of closed windows goes with the watermark."""
    ok = F.coalesce(F.col("score") >= S.PASS_SCORE, F.lit(False))
    grouped = results.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.coalesce("dimension", F.lit("none")).alias("dimension"))
    return grouped.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed")).select(F.col("w.start").alias("start"), "dimension", "total", "passed")
