"""The domain's tables as views of the given star-schema tables; the same expressions serve Spark and the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaymill import schemas as S

_TYPES = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(S.STATEMENT_TYPES)) + " END"
_PRIORITY = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'P0' WHEN '2' THEN 'P1' WHEN '3' THEN 'P1' ELSE 'P2' END"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

#: Phrases that the rules on texts tell apart, with numbers of their own.
_PHRASES = [
    "'（一）贷款额度不得超过' || k || '%。'", "'1. 应当在' || k || '天内还款；'", "'详见附件' || k", "' 本办法所称企业是指符合标准' || k || '的企业 '", "k || '-' || k", "'本办法自20' || k || '年1月1日起施行'",
    "'## Chapter ' || k", "'- item ' || k", "k || ') item'", "'某某银行在2024年人民币贷款' || k || '万元时，应付息。余额为' || k || '元；x' || k", "'{\"items\":[{\"statement\":\"s' || k || '\"}]}'",
    "'[{\"statement\":\"t' || k || '\"},{\"statement\":\"u\"}]'", "'Plain Words ' || k || ' and_more'", "'①流程分为' || k || '步，先申请再审批后放款。；'", "'较2020年度' || k || '修订'", "''",
]
_PHRASE = "CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_PHRASES)).replace(" k ", " CAST(p_partkey AS STRING) ").replace("THEN k ", "THEN CAST(p_partkey AS STRING) ").replace("|| k", "|| CAST(p_partkey AS STRING)") + " END"

#: View: (table, expressions).
VIEWS: dict[str, tuple[str, list[str]]] = {
    "document": ("nation", [
        "CAST(n_nationkey AS BIGINT) AS document_id", "n_name AS file_name", "CASE n_regionkey WHEN 0 THEN 'A' WHEN 1 THEN 'A/B' WHEN 2 THEN 'AB' WHEN 3 THEN 'A/B/C' ELSE '' END AS folder_path",
    ]),
    "block": ("customer", [
        "c_custkey AS block_id", "CAST(c_nationkey AS BIGINT) AS document_id", "c_mktsegment AS section_path",
        "CASE WHEN c_custkey % 10 = 0 THEN 'title' ELSE 'paragraph' END AS block_type", "c_name AS block_text",
    ]),
    "eiu": ("orders", [
        "o_orderkey AS eiu_id", "o_custkey AS block_id", f"{_PRIORITY} AS content_priority", f"{_TYPES} AS eiu_type", "o_orderstatus <> 'P' AS is_questionable",
        f"CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CASE {_PRIORITY} WHEN 'P0' THEN 5 WHEN 'P1' THEN 3 ELSE 1 END END AS weight",
        "CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 50 = 0 THEN '题目难生成' ELSE '无实质内容' END END AS exclusion_reason",
        "CASE WHEN o_orderkey % 97 = 0 THEN 'blocked' ELSE 'quality_verified' END AS review_status", "'Statement ' || CAST(o_orderkey % 500 AS STRING) AS statement",
    ]),
    "case": ("lineitem", [
        "l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS case_id", "l_orderkey AS eiu_id",
        "CASE WHEN l_linestatus = 'F' THEN 'retired' WHEN l_returnflag = 'R' THEN 'quality_verified' WHEN l_returnflag = 'A' THEN 'candidate' ELSE 'needs_review' END AS review_status",
        "CASE l_linenumber % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' END AS difficulty", "l_suppkey % 25 AS document_id", "'What is PART ' || CAST(l_partkey % 300 AS STRING) || CASE WHEN l_suppkey % 2 = 0 THEN '?' ELSE ' !' END AS question",
        "CAST(CAST(l_quantity AS BIGINT) AS STRING) AS gold_answer", "CASE l_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A/B' WHEN 2 THEN 'AB' ELSE 'A/B/C' END AS folder_path",
        "CASE WHEN l_discount > 0.05 THEN 'single' ELSE '' END AS scope", "CAST(NULL AS STRING) AS review_tag",
    ]),
    "result": ("events", [
        "event_id AS result_id", "user_id AS run_id", "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS dimension", "value AS latency_ms", f"{_K} AS k", f"{_K} AS tokens", f"CAST({_K} AS DOUBLE) / 8 AS cost",
        f"CASE WHEN {_K} % 3 = 0 THEN NULL ELSE 'L' || CAST({_K} % 3 AS STRING) END AS difficulty", f"CASE WHEN {_K} % 11 = 0 THEN 'timeout' END AS error",
        f"CASE WHEN {_K} % 13 = 0 THEN '' ELSE 'Ans ' || CAST({_K} % 4 AS STRING) END AS gold_answer", f"CASE WHEN {_K} % 17 = 0 THEN '' ELSE 'aNS' || CAST({_K} % 3 AS STRING) END AS answer",
        f"CASE {_K} % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 END AS n_retrieved",
    ]),
    "upload": ("conversations", [
        "conv_id * 1000 + turn AS case_id", "conv_id % 7 AS set_id", "CASE WHEN role = 'user' THEN text ELSE '' END AS q", "CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS a",
        "CASE WHEN role = 'system' THEN NULL ELSE role END AS dimension", "CASE WHEN turn % 2 = 0 THEN text END AS evidence",
    ]),
    "public": ("benchmark", ["item_id AS case_id", "item_id % 3 AS set_id", "text AS q", "CAST(item_id AS STRING) AS a", "CASE item_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS dimension"]),
    "phrase": ("part", ["CAST(p_partkey AS BIGINT) AS phrase_id", _PHRASE + " AS phrase"]),
    "vector": ("embeddings", ["vec_id AS item_id", "embedding AS vector", "label AS grp"]),
    "text": ("documents", ["doc_id AS document_id", "text", "n_chars"]),
}


#: Lines of all documents, whole, beside the phrases that rules tell apart.
LINES_SQL = """SELECT 1000000 + doc_id * 100000 + i AS phrase_id, line AS phrase FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, expressions = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*expressions)
    if name == "phrase":
        lines = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").selectExpr("doc_id", "posexplode(split(text, '\n')) AS (i, phrase)")
        rows = rows.unionByName(lines.selectExpr("1000000 + doc_id * 100000 + i + 1 AS phrase_id", "phrase"))
    return rows


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checks of each labelled case."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.selectExpr("doc_id AS case_id", "stack(2, 'faithfulness', quality = 1, 'uniqueness', toxic = 0) AS (check_type, passed)").selectExpr("*", "concat(check_type, ' failed') AS reason")


def sql_view(name: str) -> str:
    source, expressions = VIEWS[name]
    return f"SELECT {', '.join(expressions)} FROM {source}" + (f" UNION ALL {LINES_SQL}" if name == "phrase" else "")


CHECKS_SQL = """SELECT doc_id AS case_id, 'faithfulness' AS check_type, quality = 1 AS passed, 'faithfulness failed' AS reason FROM labels
UNION ALL SELECT doc_id, 'uniqueness', toxic = 0, 'uniqueness failed' FROM labels"""


def with_views(sql: str, *names: str) -> str:
    """SQL over the named views, each prefixed by ``v_``."""
    return "WITH " + ", ".join(f"v_{n} AS ({CHECKS_SQL if n == 'checks' else sql_view(n)})" for n in names) + " " + sql
