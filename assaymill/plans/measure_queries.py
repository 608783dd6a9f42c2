"""Registered queries of measures: latency sketches, retrieval, answers, crosstabs; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.operators import answers as A
from assaymill.operators import crosstabs as B
from assaymill.operators import latency as P
from assaymill.operators import retrieval as R
from assaymill.plans.queries import query
from assaymill.plans.session import temporary
from assaymill.plans.views import view


@query("""SELECT user_id AS run_id, CAST(count(*) AS BIGINT) AS n, round(avg(value), 9) AS mean, min(value) AS least, max(value) AS most, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95
FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def met_latency_by_run(s: SparkSession, d: str) -> DataFrame:
    """From stored sketches by run, kind and hour; runs have fewer rows here than a sketch keeps, so percentiles are exact."""
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("dimension"), F.col("value").alias("latency_ms"), "ts")
    path = temporary(s, "sketches")
    P.sketched(rows).write.parquet(path)
    return P.percentiles(P.rolled_up(s.read.parquet(path), ["run_id"])).withColumn("mean", F.round("mean", 9))


_TRACE = "SELECT l_orderkey AS query_id, l_partkey AS item_id, l_linenumber AS rank FROM lineitem WHERE l_linenumber <> 2"
_GOLD = "SELECT l_orderkey AS query_id, l_partkey AS item_id, CAST(l_quantity AS BIGINT) % 3 AS grade FROM lineitem WHERE l_suppkey % 2 = 0"
METRICS_SQL = f"""WITH t AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY r, item_id) AS rank FROM (SELECT query_id, item_id, min(rank) AS r FROM ({_TRACE}) GROUP BY 1, 2)),
g AS (SELECT query_id, item_id, max(grade) AS grade FROM ({_GOLD}) GROUP BY 1, 2 HAVING max(grade) > 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS place FROM g),
ks AS (SELECT unnest([1, 3, 5]) AS k), b AS (SELECT query_id, k, count(*) AS n_gold, sum(CASE WHEN place <= k THEN (2.0 ^ grade - 1) / log2(place + 1.0) END) AS best FROM o, ks GROUP BY 1, 2),
h AS (SELECT query_id, rank, grade, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM t JOIN g USING (query_id, item_id)),
f AS (SELECT query_id, k, count(*) AS n_found, min(rank) AS first, sum((2.0 ^ grade - 1) / log2(rank + 1.0)) AS gained, avg(so_far / rank) AS cp FROM h, ks WHERE rank <= k GROUP BY 1, 2),
m AS (SELECT query_id, k, n_gold, coalesce(n_found, 0) AS n_found, coalesce(n_found, 0) / n_gold AS recall, CAST(coalesce(n_found, 0) > 0 AS DOUBLE) AS hit, CAST(coalesce(n_found, 0) = n_gold AS DOUBLE) AS complete,
coalesce(1 / first, 0.0) AS mrr, coalesce(gained / best, 0.0) AS ndcg, coalesce(n_found, 0) / k AS precision, coalesce(cp, 0.0) AS context_precision FROM b LEFT JOIN f USING (query_id, k)) """


def metrics(s: SparkSession, d: str) -> DataFrame:
    """Lines of an order as what was retrieved for it, those of every other supplier as its evidence; the second line wasn't retrieved."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("rank"), (F.col("l_quantity").cast("long") % 3).alias("grade"), "l_suppkey")
    return R.retrieval_metrics(lines.where("rank <> 2"), lines.where("l_suppkey % 2 = 0"), (1, 3, 5))


@query(METRICS_SQL + "SELECT query_id, CAST(k AS INTEGER) AS k, CAST(n_gold AS BIGINT) AS n_gold, CAST(n_found AS BIGINT) AS n_found, round(recall, 6) AS recall, hit, complete, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision, round(context_precision, 6) AS context_precision FROM m")
def met_retrieval(s: SparkSession, d: str) -> DataFrame:
    return metrics(s, d).select("query_id", "k", "n_gold", "n_found", *[F.round(m, 6).alias(m) for m in R.METRICS])


@query(METRICS_SQL + "SELECT o_orderpriority AS priority, CAST(k AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS questions, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in R.METRICS) + " FROM m JOIN orders ON o_orderkey = query_id GROUP BY 1, 2")
def met_retrieval_summary(s: SparkSession, d: str) -> DataFrame:
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("priority"))
    return R.retrieval_summary(metrics(s, d), orders, ["priority"])


_W = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+')"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, {_W.format('a.text')} AS a, {_W.format('b.text')} AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
s AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS shared FROM (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS w FROM p) GROUP BY ALL) x JOIN (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS w FROM p) GROUP BY ALL) y USING (conv_id, turn, w) GROUP BY 1, 2)
SELECT conv_id, turn, CASE WHEN len(a) + len(g) = 0 THEN 1.0 ELSE round(2.0 * coalesce(shared, 0) / (len(a) + len(g)), 6) END AS f1, CASE WHEN len(a) + len(g) = 0 THEN 1.0 ELSE coalesce(round(shared / len(a), 6), 0.0) END AS precision FROM p LEFT JOIN s USING (conv_id, turn)""")
def met_token_f1(s: SparkSession, d: str) -> DataFrame:
    """Each turn against the one that follows it."""
    rows = s.read.parquet(f"{d}/conversations.parquet")
    gold = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    f = A.token_f1(F.col("text"), F.col("gold"))
    return rows.join(gold, ["conv_id", "turn"]).select("conv_id", "turn", F.round(f["f1"], 6).alias("f1"), F.round(f["precision"], 6).alias("precision"))


@query("""SELECT o_orderkey AS id, abs(p - o_totalprice) <= o_totalprice * 0.01 AS matched FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 10000, 2) * 10000 ELSE o_totalprice * (1 + (o_orderkey % 5) / 240.0) END AS p FROM orders)""")
def met_numeric(s: SparkSession, d: str) -> DataFrame:
    """Prices told in tens of thousands, or off by up to two per cent, against the price."""
    rows = s.read.parquet(f"{d}/orders.parquet")
    told = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.format_number(F.round(F.col("o_totalprice") / 10000, 2), 2), F.lit("万元")))
    told = told.otherwise(F.concat(F.lit("about "), F.format_number(F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 5) / 240), 6), F.lit(" in all")))
    return rows.select(F.col("o_orderkey").alias("id"), A.numeric_match(told, F.format_number("o_totalprice", 2)).alias("matched"))


_CASES = "SELECT c.case_id, coalesce(c.difficulty, 'none') AS difficulty, e.eiu_type AS kind, e.content_priority AS priority, c.eiu_id FROM v_case c JOIN v_eiu e USING (eiu_id)"


@query(f"""SELECT CASE WHEN grouping(difficulty) = 1 THEN 'all' ELSE difficulty END AS difficulty, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, CASE WHEN grouping(priority) = 1 THEN 'all' ELSE priority END AS priority,
CAST(grouping(difficulty) * 4 + grouping(kind) * 2 + grouping(priority) AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT eiu_id) AS BIGINT) AS distinct_eiu_id,
round(count(*) / sum(count(*)) OVER (PARTITION BY grouping(difficulty), grouping(kind), grouping(priority), CASE WHEN grouping(priority) = 0 THEN difficulty || '|' || kind WHEN grouping(kind) = 0 THEN difficulty ELSE '' END,
CASE WHEN grouping(priority) = 0 AND grouping(kind) = 1 THEN difficulty WHEN grouping(priority) = 0 AND grouping(difficulty) = 1 THEN kind ELSE '' END), 6) AS share FROM ({_CASES}) GROUP BY CUBE (difficulty, kind, priority)""", "case", "eiu")
def met_crosstab(s: SparkSession, d: str) -> DataFrame:
    """Cases over difficulty, type and priority, with all margins, and how many statements they stand for."""
    rows = view(s, d, "case").select("case_id", "difficulty", "eiu_id").join(view(s, d, "eiu").selectExpr("eiu_id", "eiu_type AS kind", "content_priority AS priority"), "eiu_id")
    return B.crosstab(rows, ["difficulty", "kind", "priority"], ["eiu_id"])


@query(f"""WITH t AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY r, item_id) AS rank FROM (SELECT query_id, item_id, min(rank) AS r FROM ({_TRACE}) GROUP BY 1, 2)), g AS (SELECT DISTINCT query_id, item_id FROM ({_GOLD})),
s AS (SELECT query_id, count(*) AS n_gold, count(CASE WHEN item_id % 40 <> 7 THEN 1 END) AS n_known, count(CASE WHEN rank <= 4 THEN 1 END) AS n_found, count(CASE WHEN rank <= 2 THEN 1 END) AS n_context FROM g LEFT JOIN t USING (query_id, item_id) GROUP BY 1),
r AS (SELECT o_orderkey AS query_id, o_orderkey % 10 < 2 AS passed, o_orderkey % 19 = 0 AS broken, o_custkey % 23 <> 0 AS answerable, o_custkey % 17 <> 0 AS sound, o_orderkey % 29 <> 0 AS represented, o_orderkey % 3 <> 0 AS faithful, o_custkey % 2 = 0 AS safe FROM orders)
SELECT query_id, CAST(coalesce(n_gold, 0) AS BIGINT) AS n_gold, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known, CAST(coalesce(n_found, 0) AS BIGINT) AS n_found, CAST(coalesce(n_context, 0) AS BIGINT) AS n_context,
CASE WHEN broken THEN 'D9' WHEN passed THEN NULL WHEN NOT answerable THEN 'D7' WHEN NOT sound OR n_gold IS NULL THEN 'D6' WHEN n_known < n_gold THEN 'D1' WHEN NOT represented THEN 'D2' WHEN n_found < n_gold THEN 'D3' WHEN n_context < n_gold THEN 'D4'
WHEN NOT safe AND faithful THEN 'D8' ELSE 'D5' END AS diagnosis FROM r LEFT JOIN s USING (query_id)""")
def met_diagnosis(s: SparkSession, d: str) -> DataFrame:
    """Why orders failed: their lines as what was retrieved, lines of every other supplier as evidence, of which parsing lost some."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("rank"), "l_suppkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    results = s.read.parquet(f"{d}/orders.parquet").select(
        k.alias("query_id"), F.when(k % 10 < 2, 1.0).otherwise(0.0).alias("score"), F.when(k % 19 == 0, "timeout").alias("error"), (c % 23 != 0).alias("answerable"), (c % 17 != 0).alias("sound"),
        (k % 29 != 0).alias("represented"), (k % 3 != 0).alias("faithful"), (c % 2 == 0).alias("safe"),
    )
    known = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("item_id")).where("item_id % 40 <> 7")
    return R.diagnosed(results, lines.where("rank <> 2"), lines.where("l_suppkey % 2 = 0"), known, 4, 2)
