"""Evaluation runs: scoring of results, summaries, error books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.scoring import advice, diagnosis, rate, run_status, score_case


def scored(results: DataFrame) -> DataFrame:
    """Adds method, em, score, status and diagnosis to rows with answer, gold_answer, error and n_retrieved."""
    out = results.withColumn("s", score_case(F.col("answer"), F.col("gold_answer"), F.col("error"))).select("*", "s.method", "s.em", "s.score").drop("s")
    code = diagnosis(F.col("answer"), F.col("gold_answer"), F.col("error"), F.col("score"), F.col("n_retrieved"))
    return out.withColumns({"status": run_status(F.col("error"), F.col("score")), "diagnosis": code})


def run_summary(results: DataFrame, by: str | None = "run_id") -> DataFrame:
    """Totals and rates of each run; results without a score count as not passed, rates without a base are null.

    ``tokens`` and ``cost`` are summed where the results have them, and ``diagnoses`` counts the results of each code.
    """
    ok, keys = F.coalesce(F.col("score") >= S.PASS_SCORE, F.lit(False)), [by] if by else []
    part = results.groupBy(*keys, "diagnosis").agg(
        F.count(F.lit(1)).alias("total"), F.count("score").alias("scored"), F.count_if(ok).alias("passed"), F.count_if(F.col("status") == "error").alias("error_count"),
        F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("total_latency_ms"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(f"total_{c}") for c in ("tokens", "cost") if c in results.columns],
    )
    code = F.when(F.col("diagnosis").isNotNull(), F.struct("diagnosis", F.col("total").alias("n")))
    codes = F.sort_array(F.collect_list(code))  # a code each, and nulls aren't collected
    sums = part.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in part.columns if c not in (*keys, "diagnosis")], F.when(F.size(codes) > 0, F.map_from_entries(codes)).alias("diagnoses"))
    sums = sums if by else sums.fillna(0, [c for c in sums.columns if c in ("total", "scored", "passed", "error_count")])
    return sums.withColumns({
        "passed_rate": rate(F.col("passed"), F.nullif(F.col("scored"), F.lit(0)), None), "error_rate": rate(F.col("error_count"), F.nullif(F.col("total"), F.lit(0)), None),
    })


def passes_by(results: DataFrame, column: str, none: str, *keys: str) -> DataFrame:
    ok = F.coalesce(F.col("score") >= S.PASS_SCORE, F.lit(False))
    name = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(none)).alias(column)
    return results.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"))


def error_book(results: DataFrame) -> DataFrame:
    """Open items of failed and errored results that have a diagnosis."""
    rows = results.where(F.col("status").isin("failed", "error") & F.col("diagnosis").isNotNull())
    return rows.select("result_id", "run_id", "diagnosis", advice(F.col("diagnosis")).alias("suggestion"), F.lit("open").alias("status"))


def clusters(items: DataFrame) -> DataFrame:
    """Items by diagnosis with advice; ``first_seen`` breaks ties of the count."""
    rows = items.where("diagnosis IS NOT NULL").groupBy("diagnosis").agg(F.count(F.lit(1)).alias("n"), F.min("result_id").alias("first_seen"))
    return rows.withColumn("optimization", advice(F.col("diagnosis")))
