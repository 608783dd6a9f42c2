"""How well retrieval finds the evidence: recall, hits, complete recall, reciprocal rank, nDCG and precision at several cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaymill import schemas as S

METRICS = ("recall", "hit", "complete", "mrr", "ndcg", "precision", "context_precision")


def retrieval_metrics(traces: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """(query_id, k, n_gold, n_found, recall, hit, complete, mrr, ndcg, precision, context_precision), a row a question with gold and cut.

    ``traces``: (query_id, item_id, rank), what was retrieved, from rank 1; ``gold``: (query_id, item_id, grade), the evidence
    a question needs. ``hit`` and ``complete`` tell apart questions of several steps: some of the evidence, and all of it. nDCG
    gains 2^grade - 1, discounted by the logarithm of the rank. ``context_precision`` is the mean, over evidence found, of
    the precision at its place; 0 where none is found. Questions that retrieved nothing score 0.

    An item that comes twice counts at its first place, and places close up behind it; a repeated gold item has its best
    grade; null grades are 1, grades below 0 are 0, and gold of grade 0 needn't be found. Null ids and ranks are left out.
    """
    every = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    once = traces.where("query_id IS NOT NULL AND item_id IS NOT NULL AND rank IS NOT NULL").groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    placed = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item_id")))
    grade = F.greatest(F.coalesce(F.col("grade").cast("double"), F.lit(1.0)), F.lit(0.0))
    wanted = gold.where("query_id IS NOT NULL AND item_id IS NOT NULL").groupBy("query_id", "item_id").agg(F.max(grade).alias("grade")).where("grade > 0")
    ideal = wanted.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "item_id")))
    gain = lambda place: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1.0)
    best = ideal.select("*", every).groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("n_gold"), F.sum(F.when(F.col("place") <= F.col("k"), gain("place"))).alias("best"))
    hits = placed.join(wanted, ["query_id", "item_id"])
    hits = hits.withColumn("so_far", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    found = hits.select("*", every).where("rank <= k").groupBy("query_id", "k").agg(
        F.count(F.lit(1)).alias("n_found"), F.min("rank").alias("first"), F.sum(gain("rank")).alias("gained"), F.avg(F.col("so_far") / F.col("rank")).alias("context_precision")
    )
    n = F.coalesce("n_found", F.lit(0)).cast("long")
    return best.join(found, ["query_id", "k"], "left").select(
        "query_id", "k", "n_gold", n.alias("n_found"), (n / F.col("n_gold")).alias("recall"), (n > 0).cast("double").alias("hit"), (n == F.col("n_gold")).cast("double").alias("complete"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("gained") / F.col("best"), F.lit(0.0)).alias("ndcg"), (n / F.col("k")).alias("precision"),
        F.coalesce("context_precision", F.lit(0.0)).alias("context_precision"),
    )


def retrieval_summary(metrics: DataFrame, groups: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., k, questions, mean of each metric); ``groups`` (query_id, ...) gives the columns to group by."""
    rows = metrics if groups is None else metrics.join(groups.select("query_id", *by), "query_id")
    return rows.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def diagnosed(results: DataFrame, traces: DataFrame, gold: DataFrame, known: DataFrame, k: int = 5, budget: int = 3) -> DataFrame:
    """(query_id, n_gold, n_known, n_found, n_context, diagnosis): the first cause of each failed result, in the order in which causes exclude each other.

    ``results``: (query_id, score, error, answerable, sound, represented, faithful, safe), of which flags that are null are
    taken as good; ``known``: (item_id), the evidence that parsing kept. An error is D9; a question that the material
    can't answer D7; an unsound sample, or one without gold evidence, D6; evidence that parsing lost D1; terms or
    relations that are wrong D2; evidence that isn't among the first ``k`` D3; evidence that isn't among the ``budget`` that
    went into the context D4; a faithful answer that breaks a rule D8; any other D5. Results that passed have none.
    """
    once = traces.where("query_id IS NOT NULL AND item_id IS NOT NULL AND rank IS NOT NULL").groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    placed = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item_id")))
    wanted = gold.where("query_id IS NOT NULL AND item_id IS NOT NULL").select("query_id", "item_id").distinct()
    there = known.select("item_id", F.lit(True).alias("_known")).distinct()
    sums = wanted.join(placed, ["query_id", "item_id"], "left").join(there, "item_id", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_gold"), F.count("_known").alias("n_known"), F.count_if(F.col("rank") <= k).alias("n_found"), F.count_if(F.col("rank") <= budget).alias("n_context")
    )
    counts = ("n_gold", "n_known", "n_found", "n_context")
    rows = results.join(sums, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    bad = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    fewer = lambda c: F.col(c) < F.col("n_gold")
    code = (
        F.when(F.col("error").isNotNull(), "D9").when(F.coalesce(F.col("score") >= S.PASS_SCORE, F.lit(False)), None).when(bad("answerable"), "D7").when(bad("sound") | (F.col("n_gold") == 0), "D6")
        .when(fewer("n_known"), "D1").when(bad("represented"), "D2").when(fewer("n_found"), "D3").when(fewer("n_context"), "D4").when(bad("safe") & ~bad("faithful"), "D8").otherwise("D5")
    )
    return rows.select("query_id", *counts, code.alias("diagnosis"))
