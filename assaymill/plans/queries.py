"""Registered queries of the reference's operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions import scoring, text
from assaymill.operators import cases as C
from assaymill.operators import coverage as V
from assaymill.operators import evalsets as U
from assaymill.operators import evaluate as E
from assaymill.operators import extraction as X
from assaymill.operators import folders as D
from assaymill.operators import generation as G
from assaymill.operators import lookups as L
from assaymill.operators import parsing as P
from assaymill.operators import quality as Q
from assaymill.operators import vectors as T
from assaymill.plans.views import checks, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL over the named views."""

    def register(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


ACTIVE = """, active AS (SELECT e.*, b.document_id, b.section_path, d.file_name AS document_name FROM v_eiu e
JOIN v_block b USING (block_id) JOIN v_document d ON d.document_id = b.document_id WHERE e.review_status <> 'blocked'),
covered AS (SELECT DISTINCT eiu_id FROM v_case WHERE review_status IN ('quality_verified', 'governance_passed', 'user_confirmed', 'published')) """
REPORT = ("eiu", "block", "document", "case")


def _sql(sql: str) -> str:
    """SQL after the common tables of the coverage report."""
    return ACTIVE.lstrip() + sql


def report_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    blocks, documents = view(s, d, "block"), view(s, d, "document")
    return V.active(view(s, d, "eiu"), blocks, documents), blocks, documents, V.covered_ids(view(s, d, "case"))


def covering(sql: str) -> tuple[str, ...]:
    return (ACTIVE + sql, *REPORT)


@query(*covering("""SELECT CAST(count(*) AS BIGINT) AS total_eiu, CAST(sum(CASE WHEN is_questionable THEN 1 ELSE 0 END) AS BIGINT) AS questionable_eiu,
CAST(sum(CASE WHEN is_questionable THEN 0 ELSE 1 END) AS BIGINT) AS excluded_eiu FROM active"""))
def agg01_totals(s: SparkSession, d: str) -> DataFrame:
    return V.totals(report_tables(s, d)[0])


@query(*covering("""SELECT p AS content_priority, CAST(sum(CASE WHEN content_priority = p THEN 1 ELSE 0 END) AS BIGINT) AS eiu_count
FROM active, (VALUES ('P0'), ('P1'), ('P2')) t(p) GROUP BY p"""))
def agg02_by_priority(s: SparkSession, d: str) -> DataFrame:
    return V.by_priority(report_tables(s, d)[0])


@query(*covering("SELECT eiu_type, CAST(count(*) AS BIGINT) AS eiu_count FROM active GROUP BY eiu_type"))
def agg03_by_type(s: SparkSession, d: str) -> DataFrame:
    return V.by_type(report_tables(s, d)[0])


@query(*covering("SELECT document_id, CAST(count(*) AS BIGINT) AS eiu_count, document_name FROM active GROUP BY document_id, document_name"))
def agg04_by_document(s: SparkSession, d: str) -> DataFrame:
    eiu, _, documents, _ = report_tables(s, d)
    return V.by_document(eiu, documents)


@query(*covering("SELECT section_path, CAST(count(*) AS BIGINT) AS eiu_count FROM active WHERE section_path <> '' GROUP BY section_path"))
def agg05_by_section(s: SparkSession, d: str) -> DataFrame:
    return V.by_section(report_tables(s, d)[0])


@query(*covering("""SELECT CAST(sum(w) AS BIGINT) AS total_weight, CAST(sum(CASE WHEN c THEN w ELSE 0 END) AS BIGINT) AS covered_weight,
CAST(sum(p) AS BIGINT) AS p0_total, CAST(sum(CASE WHEN c THEN p ELSE 0 END) AS BIGINT) AS p0_covered,
round(sum(CASE WHEN c THEN w ELSE 0 END) / CAST(sum(w) AS DOUBLE), 4) AS weighted_coverage, round(sum(CASE WHEN c THEN p ELSE 0 END) / CAST(sum(p) AS DOUBLE), 4) AS p0_coverage_pct
FROM (SELECT coalesce(weight, CASE content_priority WHEN 'P0' THEN 5 WHEN 'P1' THEN 3 ELSE 1 END) AS w, CASE content_priority WHEN 'P0' THEN 1 ELSE 0 END AS p,
eiu_id IN (SELECT eiu_id FROM covered) AS c FROM active WHERE is_questionable)"""))
def agg06_weighted_coverage(s: SparkSession, d: str) -> DataFrame:
    eiu, _, _, covered = report_tables(s, d)
    return V.weighted(eiu, covered)


@query(*covering("""SELECT CAST((SELECT count(*) FROM v_block WHERE block_type <> 'title') AS BIGINT) AS total_paragraph_blocks, CAST(count(DISTINCT block_id) AS BIGINT) AS covered_blocks,
round(count(DISTINCT block_id) / CAST((SELECT count(*) FROM v_block WHERE block_type <> 'title') AS DOUBLE), 4) AS rate FROM active"""))
def agg08_reconciliation(s: SparkSession, d: str) -> DataFrame:
    eiu, blocks, _, _ = report_tables(s, d)
    return V.reconciliation(eiu, blocks)


@query(*covering(""", s AS (SELECT count(*) AS n, sum(CASE WHEN is_questionable THEN 0 ELSE 1 END) AS o, min(CASE WHEN exclusion_reason LIKE '%难生成%' AND NOT is_questionable THEN eiu_id END) AS bad,
count(DISTINCT block_id) AS c, (SELECT count(*) FROM v_block WHERE block_type <> 'title') AS t, (SELECT count(*) FROM v_block WHERE block_type <> 'title' AND block_id NOT IN (SELECT block_id FROM active)) AS u FROM active)
SELECT concat_ws(chr(10), CASE WHEN o > 0.5 * n THEN '排除记录占比 ' || CAST(CAST(round(o * 100.0 / n) AS INTEGER) AS STRING) || '% 超过 50%，疑似覆盖率分母被人为排空，请检查 exclusion_reason' END,
CASE WHEN bad IS NOT NULL THEN 'EIU ' || CAST(bad AS STRING) || ' 的排除原因不合理（' || (SELECT exclusion_reason FROM active WHERE eiu_id = bad) || '），不得因''题目难生成''排除' END,
CASE WHEN c < t THEN '实质 Block 对账率 ' || CAST(CAST(round(c * 100.0 / t) AS INTEGER) AS STRING) || '% < 100%，有 ' || CAST(u AS STRING) || ' 个段落未生成 EIU 或排除记录' END) AS alerts FROM s"""))
def agg09_alerts(s: SparkSession, d: str) -> DataFrame:
    eiu, blocks, _, _ = report_tables(s, d)
    return V.alerts(eiu, blocks).select(F.array_join("alerts", "\n").alias("alerts"))


@query(*covering("""SELECT w >= 0.85 AND p >= 1 AND r >= 1 AS gate_passed, CASE WHEN w < 0.85 THEN 'weighted_coverage,' ELSE '' END || CASE WHEN p < 1 THEN 'p0_coverage,' ELSE '' END || CASE WHEN r < 1 THEN 'reconciliation,' ELSE '' END AS failures FROM (
SELECT round(sum(CASE WHEN is_questionable AND c THEN w ELSE 0 END) / CAST(sum(CASE WHEN is_questionable THEN w END) AS DOUBLE), 4) AS w,
round(sum(CASE WHEN is_questionable AND c AND content_priority = 'P0' THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN is_questionable AND content_priority = 'P0' THEN 1 END) AS DOUBLE), 4) AS p,
round(count(DISTINCT block_id) / CAST((SELECT count(*) FROM v_block WHERE block_type <> 'title') AS DOUBLE), 4) AS r FROM (
SELECT *, coalesce(weight, CASE content_priority WHEN 'P0' THEN 5 WHEN 'P1' THEN 3 ELSE 1 END) AS w, eiu_id IN (SELECT eiu_id FROM covered) AS c FROM active))"""))
def agg10_gate(s: SparkSession, d: str) -> DataFrame:
    eiu, blocks, _, covered = report_tables(s, d)
    row = V.weighted(eiu, covered).join(F.broadcast(V.reconciliation(eiu, blocks)))
    out = row.select(*V.gate(F.col("weighted_coverage"), F.col("p0_coverage_pct"), F.col("rate")))
    return out.select("gate_passed", F.array_join(F.transform("failures", lambda x: F.concat(x, F.lit(","))), "").alias("failures"))


@query("SELECT DISTINCT eiu_id FROM v_case WHERE review_status IN ('quality_verified', 'governance_passed', 'user_confirmed', 'published')", "case")
def agg11_covered_ids(s: SparkSession, d: str) -> DataFrame:
    return V.covered_ids(view(s, d, "case"))


@query("""SELECT dimension, key, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'difficulty' AS dimension, coalesce(nullif(difficulty, ''), 'unknown') AS key FROM v_case
UNION ALL SELECT 'scope', coalesce(nullif(scope, ''), 'unknown') FROM v_case UNION ALL SELECT 'review_status', review_status FROM v_case) GROUP BY dimension, key""", "case")
def agg12_case_statistics(s: SparkSession, d: str) -> DataFrame:
    return C.statistics(view(s, d, "case"), "difficulty", "scope", "review_status", limit=None)


@query("""SELECT dimension, key, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM v_case ORDER BY case_id LIMIT 200),
LATERAL (SELECT 'difficulty' AS dimension, coalesce(nullif(difficulty, ''), 'unknown') AS key UNION ALL SELECT 'scope', coalesce(nullif(scope, ''), 'unknown')) GROUP BY dimension, key""", "case")
def agg12_statistics_of_page(s: SparkSession, d: str) -> DataFrame:
    """The reference counts its first page of 200 cases; the limit is that page."""
    return C.statistics(view(s, d, "case"), "difficulty", "scope")


@query(*covering(""", pub AS (SELECT c.*, a.section_path, a.document_name FROM v_case c LEFT JOIN active a USING (eiu_id) WHERE c.review_status = 'quality_verified'),
cs AS (SELECT coalesce(section_path, '未分类') AS section_path, count(*) AS case_count FROM pub GROUP BY 1),
es AS (SELECT section_path, count(*) AS eiu_count, sum(CASE WHEN is_questionable THEN 1 ELSE 0 END) AS q, sum(CASE WHEN is_questionable AND eiu_id IN (SELECT eiu_id FROM covered) THEN 1 ELSE 0 END) AS c FROM active GROUP BY 1)
SELECT section_path, CAST(coalesce(eiu_count, 0) AS BIGINT) AS eiu_count, CAST(coalesce(case_count, 0) AS BIGINT) AS case_count, round(coalesce(c * 100.0 / q, 0), 1) :: DOUBLE AS coverage_pct,
CAST(greatest(coalesce(q, 0) - coalesce(c, 0), 0) AS BIGINT) AS gap FROM cs FULL JOIN es USING (section_path)"""))
def agg13_section_tree(s: SparkSession, d: str) -> DataFrame:
    eiu, _, _, _ = report_tables(s, d)
    return V.section_tree(eiu, V.publishable(view(s, d, "case"))).drop("documents")


@query(*covering(""", pub AS (SELECT coalesce(a.section_path, '未分类') AS section_path, coalesce(a.document_name, '未关联文档') AS document_name FROM v_case c LEFT JOIN active a USING (eiu_id) WHERE c.review_status = 'quality_verified')
SELECT section_path, document_name, CAST(count(*) AS BIGINT) AS n FROM pub GROUP BY 1, 2"""))
def jn08_case_documents(s: SparkSession, d: str) -> DataFrame:
    eiu, _, _, _ = report_tables(s, d)
    tree = V.section_tree(eiu, V.publishable(view(s, d, "case")))
    return tree.select("section_path", F.explode("documents").alias("document_name", "n")).where("n > 0").select("section_path", "document_name", F.col("n").cast("long").alias("n"))


@query("""SELECT e.eiu_id, b.block_id, b.section_path, d.file_name AS document_name FROM v_eiu e JOIN v_block b USING (block_id) JOIN v_document d ON d.document_id = b.document_id
WHERE e.review_status <> 'blocked'""", "eiu", "block", "document")
def jn01_joined_statements(s: SparkSession, d: str) -> DataFrame:
    return report_tables(s, d)[0].select("eiu_id", "block_id", "section_path", "document_name")


@query("SELECT b.block_id FROM v_block b WHERE EXISTS (SELECT 1 FROM v_document d WHERE d.document_id = b.document_id)", "block", "document")
def jn02_blocks_of_documents(s: SparkSession, d: str) -> DataFrame:
    return L.blocks_of(view(s, d, "block"), view(s, d, "document")).select("block_id")


@query(*covering("SELECT eiu_id, content_priority, section_path FROM active WHERE is_questionable AND eiu_id NOT IN (SELECT eiu_id FROM covered)"))
def jn05_gaps(s: SparkSession, d: str) -> DataFrame:
    eiu, _, _, covered = report_tables(s, d)
    return V.gaps(eiu, covered).select("eiu_id", "content_priority", "section_path")


@query("SELECT eiu_id FROM v_eiu WHERE is_questionable AND eiu_id NOT IN (SELECT eiu_id FROM v_case WHERE review_status <> 'retired')", "eiu", "case")
def jn06_pending_generation(s: SparkSession, d: str) -> DataFrame:
    return C.pending(view(s, d, "eiu"), view(s, d, "case")).select("eiu_id")


@query(*covering("SELECT block_id, section_path FROM v_block WHERE block_type <> 'title' AND block_id NOT IN (SELECT block_id FROM active WHERE content_priority = 'P0')"))
def jn07_uncovered_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks without a statement of the first priority."""
    eiu, blocks, _, _ = report_tables(s, d)
    return V.uncovered_blocks(C.having(eiu, content_priority="P0"), blocks)


@query("""SELECT eiu_id, content_priority, eiu_type FROM v_eiu JOIN v_block USING (block_id) WHERE eiu_type IN ('rule', 'date') AND content_priority = 'P1' AND is_questionable
AND section_path LIKE '%BUILD%' AND review_status <> 'blocked'""", "eiu", "block")
def flt01_statements(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "eiu").join(view(s, d, "block"), "block_id")
    return C.filter_statements(rows, types=["rule", "date"], priorities="P1", questionable=True, section="BUILD").select("eiu_id", "content_priority", "eiu_type")


@query("SELECT case_id, review_status FROM v_case WHERE document_id = 3 AND folder_path = 'A/B' AND difficulty = 'L2' AND review_status <> 'retired'", "case")
def flt02_cases(s: SparkSession, d: str) -> DataFrame:
    return C.filter_cases(view(s, d, "case"), document_id=3, folder_path="A/B", difficulty="L2").select("case_id", "review_status")


@query("SELECT case_id, question FROM v_case WHERE review_status = 'quality_verified' ORDER BY case_id LIMIT 50 OFFSET 100", "case")
def flt03_case_page(s: SparkSession, d: str) -> DataFrame:
    """A page is what this operator returns."""
    return C.page(V.publishable(view(s, d, "case")), F.col("case_id"), limit=50, offset=100).select("case_id", "question")


@query("SELECT document_id, file_name FROM v_document WHERE coalesce(folder_path, '') = ''", "document")
def flt06_root_documents(s: SparkSession, d: str) -> DataFrame:
    return L.documents_in_folder(view(s, d, "document")).select("document_id", "file_name")


@query("SELECT case_id, eiu_id FROM v_case WHERE review_status IN ('quality_verified', 'governance_passed', 'user_confirmed', 'published') AND document_id IN (1, 2)", "case")
def flt07_publishable(s: SparkSession, d: str) -> DataFrame:
    return V.publishable(view(s, d, "case"), [1, 2]).select("case_id", "eiu_id")


@query("""SELECT case_id, q <> '' AND length(a) >= 8 AND coalesce(evidence, '') NOT IN ('', '—') AS accepted FROM v_upload""", "upload")
def flt09_row_gate(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "upload").select("case_id", L.accepted(F.col("q"), F.col("a"), F.col("evidence")).alias("accepted"))


@query("SELECT document_id, CAST(count(*) AS BIGINT) AS n FROM v_block WHERE block_type <> 'title' GROUP BY document_id", "block")
def flt12_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return L.paragraphs(view(s, d, "block"))


@query("SELECT eiu_id, CASE WHEN content_priority = 'P0' OR eiu_type IN ('threshold', 'definition', 'rule', 'prohibition', 'exception') THEN 'L2' ELSE 'L1' END AS difficulty FROM v_eiu", "eiu")
def prj04_difficulty(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "eiu").select("eiu_id", scoring.difficulty(F.col("eiu_type"), F.col("content_priority")).alias("difficulty"))


@query("SELECT 'v1.0.' || CAST(max(version_id) AS STRING) AS latest, 'v1.0.' || CAST(max(version_id) + 1 AS STRING) AS next FROM (SELECT n_nationkey AS version_id FROM nation)")
def prj09_next_version(s: SparkSession, d: str) -> DataFrame:
    versions = view(s, d, "document").select(F.col("document_id").alias("version_id"), F.format_string("v1.0.%d", "document_id").alias("version_number"))
    latest = versions.agg(F.max_by("version_number", "version_id").alias("latest"))
    return latest.withColumn("next", scoring.next_version(F.col("latest")))


@query(""", results AS (SELECT *, error IS NULL AND trim(gold_answer) <> '' AS judged, lower(replace(answer, ' ', '')) = lower(replace(gold_answer, ' ', '')) AS em FROM v_result),
s AS (SELECT *, CASE WHEN judged THEN CASE WHEN em THEN 1.0 ELSE 0.0 END :: DOUBLE END AS score FROM results) SELECT result_id, score,
CASE WHEN error IS NOT NULL THEN 'error' WHEN score IS NULL THEN 'unscored' WHEN score >= 0.5 THEN 'passed' ELSE 'failed' END AS status,
CASE WHEN error IS NOT NULL THEN 'D9' WHEN gold_answer = '' THEN CASE WHEN answer = '' THEN 'D6' END WHEN score >= 0.5 OR n_retrieved IS NULL THEN NULL WHEN n_retrieved = 0 THEN 'D3' ELSE 'D5' END AS diagnosis FROM s""", "result")
def scr01_scores(s: SparkSession, d: str) -> DataFrame:
    return E.scored(view(s, d, "result")).select("result_id", "score", "status", "diagnosis")


SCORED = SQL["scr01_scores"]
RESULTS = f"WITH r AS (SELECT x.*, v.run_id, v.dimension, v.difficulty, v.latency_ms, v.tokens, v.cost FROM ({SCORED}) x JOIN ({with_views('SELECT * FROM v_result', 'result')}) v USING (result_id)) "


def scored_results(s: SparkSession, d: str) -> DataFrame:
    return E.scored(view(s, d, "result"))


@query(RESULTS + """SELECT run_id, CAST(count(*) AS BIGINT) AS total, CAST(count(score) AS BIGINT) AS scored, CAST(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS passed,
CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_count, round(sum(latency_ms), 2) AS total_latency_ms,
round(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) / nullif(CAST(count(score) AS DOUBLE), 0), 4) AS passed_rate, round(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS error_rate,
CAST(sum(tokens) AS BIGINT) AS total_tokens, sum(cost) AS total_cost, (SELECT string_agg(x.diagnosis || ':' || CAST(x.n AS STRING), ',' ORDER BY x.diagnosis) FROM (SELECT diagnosis, count(*) AS n FROM r y WHERE y.run_id = r.run_id AND diagnosis IS NOT NULL GROUP BY diagnosis) x) AS diagnoses
FROM r GROUP BY run_id""")
def agg14_run_summary(s: SparkSession, d: str) -> DataFrame:
    codes = F.transform(F.map_entries("diagnoses"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return E.run_summary(scored_results(s, d)).withColumns({"total_latency_ms": F.round("total_latency_ms", 2), "diagnoses": F.array_join(codes, ",")})


@query(RESULTS + """SELECT coalesce(difficulty, 'unknown') AS difficulty, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM r GROUP BY 1""")
def agg15_by_difficulty(s: SparkSession, d: str) -> DataFrame:
    return E.passes_by(scored_results(s, d), "difficulty", "unknown")


@query(RESULTS + """SELECT coalesce(dimension, 'none') AS dimension, run_id, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM r GROUP BY 1, 2""")
def agg15_by_dimension(s: SparkSession, d: str) -> DataFrame:
    return E.passes_by(scored_results(s, d), "dimension", "none", "run_id")


@query(RESULTS + "SELECT diagnosis, CAST(count(*) AS BIGINT) AS n, min(result_id) AS first_seen FROM r WHERE diagnosis IS NOT NULL AND status IN ('failed', 'error') GROUP BY diagnosis")
def agg16_error_clusters(s: SparkSession, d: str) -> DataFrame:
    return E.clusters(E.error_book(scored_results(s, d))).select("diagnosis", "n", "first_seen")


@query(RESULTS + "SELECT result_id, run_id, diagnosis FROM r WHERE diagnosis = 'D3' AND status = 'failed'")
def flt04_error_book(s: SparkSession, d: str) -> DataFrame:
    return C.having(E.error_book(scored_results(s, d)), diagnosis="D3", status="open").select("result_id", "run_id", "diagnosis")


@query("SELECT check_type, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN passed THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM v_checks GROUP BY check_type", "checks")
def agg17_by_check_type(s: SparkSession, d: str) -> DataFrame:
    return Q.by_check_type(checks(s, d))


@query(""", c AS (SELECT doc_id AS case_id FROM documents WHERE doc_id % 9 <> 0), p AS (SELECT case_id, bool_and(passed) AS ok FROM v_checks GROUP BY case_id)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(ok) AS BIGINT) AS checked, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM c LEFT JOIN p USING (case_id)""", "checks")
def agg18_quality_summary(s: SparkSession, d: str) -> DataFrame:
    cases = view(s, d, "text").select(F.col("document_id").alias("case_id"), F.when(F.col("document_id") % 9 == 0, "retired").otherwise("candidate").alias("review_status"))
    return Q.summary(cases, checks(s, d))


@query("""SELECT case_id, CAST(count(*) AS BIGINT) AS n_checks, bool_and(passed) AS passed, coalesce(string_agg(CASE WHEN NOT passed THEN reason END, ';' ORDER BY check_type), '') AS reasons FROM v_checks GROUP BY case_id""", "checks")
def agg19_case_checks(s: SparkSession, d: str) -> DataFrame:
    return Q.by_case(checks(s, d)).select("case_id", "n_checks", "passed", "reasons")


@query("""SELECT case_id, CASE WHEN h + f = 0 THEN 'quality_verified' ELSE 'needs_review' END AS review_status, CASE WHEN h + f = 0 THEN NULL WHEN h = 0 THEN 'answer_coverage' ELSE 'generation_issue' END AS review_tag FROM (
SELECT case_id, sum(CASE WHEN NOT passed AND check_type = 'faithfulness' THEN 1 ELSE 0 END) AS h, sum(CASE WHEN NOT passed AND check_type = 'uniqueness' THEN 1 ELSE 0 END) AS f FROM v_checks GROUP BY case_id)""", "checks")
def wfl08_transitions(s: SparkSession, d: str) -> DataFrame:
    cases = view(s, d, "text").select(F.col("document_id").alias("case_id"))
    return Q.transition(cases, checks(s, d)).drop("regenerate")


SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"


@query(f""", k AS (SELECT *, regexp_replace(lower(q), '{SPACE}', '', 'g') AS key, length(trim(q)) > 0 AND length(trim(a)) > 0 AS complete FROM v_upload)
SELECT set_id, CAST(count(*) AS BIGINT) AS total, round(sum(CASE WHEN complete THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS data_completeness_rate,
round((count(nullif(key, '')) - count(DISTINCT nullif(key, ''))) / CAST(count(*) AS DOUBLE), 4) AS duplicate_question_ratio, round(sum(CASE WHEN complete AND length(trim(q)) >= 2 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS valid_qa_ratio,
CAST(count(nullif(key, '')) - count(DISTINCT nullif(key, '')) AS BIGINT) AS duplicate_count, CAST(sum(CASE WHEN coalesce(trim(evidence), '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS no_evidence_count,
string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS covered_dimensions FROM k GROUP BY set_id""", "upload")
def agg20_upload_quality(s: SparkSession, d: str) -> DataFrame:
    return U.assessed(view(s, d, "upload"), ["set_id"]).withColumn("covered_dimensions", F.array_join("covered_dimensions", ","))


KEY = "lower(regexp_replace(question, '[ ?!]', '', 'g'))"


@query(f"SELECT case_id, row_number() OVER (PARTITION BY {KEY} ORDER BY case_id DESC) = 1 AS kept FROM v_case WHERE review_status = 'quality_verified'", "case")
def agg21_exact_dedup(s: SparkSession, d: str) -> DataFrame:
    return C.dedup_exact(V.publishable(view(s, d, "case"))).select("case_id", "kept")


@query(f"""SELECT case_id, printf('case_%04d_%06d', 7, case_id) AS case_uid FROM (SELECT case_id, row_number() OVER (PARTITION BY {KEY} ORDER BY case_id DESC) AS r FROM v_case WHERE review_status = 'quality_verified') WHERE r = 1""", "case")
def wfl09_freeze(s: SparkSession, d: str) -> DataFrame:
    return C.freeze(view(s, d, "case"), 7).select("case_id", "case_uid")


@query("""SELECT eiu_id, is_questionable AND block_id = min(CASE WHEN is_questionable THEN block_id END) OVER (PARTITION BY statement) AS is_questionable FROM v_eiu""", "eiu")
def agg23_dedup_across_blocks(s: SparkSession, d: str) -> DataFrame:
    return X.across_blocks(view(s, d, "eiu")).select("eiu_id", "is_questionable")


@query("""SELECT prefix, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(CASE folder_path WHEN 'A' THEN ['A'] WHEN 'A/B' THEN ['A', 'A/B'] WHEN 'AB' THEN ['AB'] ELSE ['A', 'A/B', 'A/B/C'] END) AS prefix FROM v_case) GROUP BY prefix""", "case")
def agg25_folder_rollup(s: SparkSession, d: str) -> DataFrame:
    return D.rollup(view(s, d, "case"))


@query("""SELECT block_id, coalesce(lag(block_text) OVER w, '') AS previous_text, coalesce(lead(block_text) OVER w, '') AS next_text FROM v_block WINDOW w AS (PARTITION BY document_id ORDER BY block_id)""", "block")
def win01_neighbours(s: SparkSession, d: str) -> DataFrame:
    return P.neighbours(view(s, d, "block")).select("block_id", "previous_text", "next_text")


@query("""SELECT block_id, coalesce(CAST(lag(block_id) OVER w AS STRING) || ',', '') || coalesce(CAST(lead(block_id) OVER w AS STRING) || ',', '') AS context_ids FROM v_block WINDOW w AS (PARTITION BY document_id ORDER BY block_id)""", "block")
def win02_context(s: SparkSession, d: str) -> DataFrame:
    return P.context(view(s, d, "block")).select("block_id", F.array_join(F.transform("context_ids", lambda x: F.concat(x.cast("string"), F.lit(","))), "").alias("context_ids"))


@query("""SELECT document_id, CAST(line_no - 1 AS INTEGER) AS line_no, CAST(start AS BIGINT) AS start, CAST(start + length(line) AS BIGINT) AS "end" FROM (
SELECT document_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM v_text)) WHERE trim(line) <> ''""", "text")
def win06_line_offsets(s: SparkSession, d: str) -> DataFrame:
    return P.lines(view(s, d, "text")).select("document_id", "line_no", "start", "end")


W = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


#: Lines of texts, folded into blocks: the state is the size so far, as one block's text would have.
BLOCKS_SQL = f"""WITH RECURSIVE v_text AS (SELECT doc_id AS document_id, text FROM documents),
raw AS (SELECT document_id, {trim_sql("unnest(string_split(text, chr(10)))")} AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM v_text),
kinds AS (SELECT document_id, line_no, regexp_extract(s, '^(#{{1,6}}){W}+', 1) AS marks, s, regexp_matches(s, '^([-*+]|[0-9]+[.)]){W}+') AS item FROM raw WHERE s <> ''),
l AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY line_no) AS rn, CASE WHEN marks <> '' THEN 'title' WHEN item THEN 'list_item' ELSE 'paragraph' END AS kind,
CASE WHEN marks <> '' THEN length(marks) END AS level, CASE WHEN marks <> '' THEN {trim_sql("substr(s, length(marks) + 1)")} ELSE s END AS text FROM kinds),
f AS (SELECT document_id, rn, kind, level, text, length(text) AS size, 0 AS position FROM l WHERE rn = 1
UNION ALL SELECT l.document_id, l.rn, l.kind, l.level, l.text, CASE WHEN j.j THEN f.size + 1 + length(l.text) ELSE length(l.text) END, CASE WHEN j.j THEN f.position ELSE f.position + 1 END
FROM f JOIN l ON l.document_id = f.document_id AND l.rn = f.rn + 1, LATERAL (SELECT f.level IS NULL AND l.level IS NULL AND f.kind = l.kind AND (f.size + length(l.text) <= 1200
OR (f.size + length(l.text) <= 2400 AND NOT regexp_matches(f.text, '[。！？；;….]$'))) AS j) j),
b AS (SELECT document_id, position, min(kind) AS block_type, min(level) AS level, string_agg(text, chr(10) ORDER BY rn) AS text FROM f GROUP BY document_id, position)"""
_BEFORE = "OVER (PARTITION BY document_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LAST = ", ".join(f"max(CASE WHEN level = {k} THEN position END) {_BEFORE} AS p{k}, last_value(CASE WHEN level = {k} THEN text END IGNORE NULLS) {_BEFORE} AS t{k}" for k in range(1, 7))
_HIGHER = {k: f"greatest({', '.join(f'coalesce(p{j}, -1)' for j in range(1, k))}, -1)" if k > 1 else "-1" for k in range(1, 7)}
_ABOVE = ", ".join(f"CASE WHEN p{k} > {_HIGHER[k]} AND (level IS NULL OR {k} < level) THEN t{k} END" for k in range(1, 7))


def parsed_blocks(s: SparkSession, d: str) -> DataFrame:
    return P.merged(P.lines(view(s, d, "text")))


@query(f"""{BLOCKS_SQL}, p AS (SELECT *, {_LAST} FROM b)
SELECT document_id, position, block_type, coalesce(nullif(array_to_string(list_filter([{_ABOVE}], lambda x: x IS NOT NULL), ' / '), ''), '{S.UNFILED}') AS section_path, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM p""")
def win05_merged_blocks(s: SparkSession, d: str) -> DataFrame:
    return P.hierarchy(parsed_blocks(s, d)).select("document_id", "position", "block_type", "section_path", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query(f"""{BLOCKS_SQL} SELECT document_id, position, row_number() OVER (ORDER BY document_id, position) AS block_id FROM b""")
def snk10_block_ids(s: SparkSession, d: str) -> DataFrame:
    return P.with_ids(P.hierarchy(parsed_blocks(s, d))).select("document_id", "position", "block_id")


def skip_sql(c: str) -> str:
    t, words = trim_sql(c), "|".join(S.SKIP_WORDS)
    return f"(length({t}) <= 2 OR regexp_matches({t}, '^({W}|[0-9\\-—.·/\\\\|，,、])+$') OR (regexp_matches({t}, '{words}') AND length({t}) < 40))"


def classified_sql(c: str) -> str:
    """The number of the first rule that holds, the last for plain long sentences."""
    rules = " ".join(f"WHEN {' AND '.join(f'regexp_matches({c}, $${p}$$)' for p in patterns)} THEN {i}" for i, (_, _, patterns) in enumerate(S.RULES))
    return f"CASE WHEN length({c}) < 4 THEN NULL {rules} WHEN length({c}) >= 8 THEN {len(S.RULES)} END"


def truncated_sql(c: str) -> str:
    cut = f"substr({c}, 1, {S.MAX_STATEMENT})"
    end = lambda x: f"length({cut}) - instr(reverse({cut}), {x}) + 1"
    stops = " ".join(f"WHEN contains({cut}, {x}) AND {end(x)} > 1 THEN substr({cut}, 1, {end(x)})" for x in ("'。'", "'；'", "'！'", "'？'", "chr(10)", "'，'"))
    return f"CASE WHEN length({c}) <= {S.MAX_STATEMENT} THEN {c} {stops} ELSE {cut} END"


_KINDS = [(kind, priority) for kind, priority, _ in S.RULES] + [("rule", "P2")]
_NUMBERING = f"^(?:[（(]{W}*[一二三四五六七八九十0-9]+{W}*[）)]|[①②③④⑤⑥⑦⑧⑨⑩]+|[0-9]+{W}*[、.．])"
_CLEAN = trim_sql("regexp_replace(" + trim_sql(f"regexp_replace(sentence, '{_NUMBERING}', '')") + f", '({W}|[。；;])+$', '')")
_KEY = "lower(regexp_replace(statement, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9]', '', 'g'))"


@query(f"""{BLOCKS_SQL}, blocks AS (SELECT document_id * 100000 + position AS block_id, text FROM b WHERE block_type <> 'title'),
parts AS (SELECT block_id, list_filter(list_transform(regexp_split_to_array(text, '[。；;\\n]+'), lambda x: {trim_sql("x")}), lambda x: x <> '') AS parts FROM blocks WHERE NOT {skip_sql("text")}),
sentences AS (SELECT block_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS position FROM parts),
ruled AS (SELECT block_id, position, {classified_sql("sentence")} AS rule, {_CLEAN} AS whole FROM sentences WHERE NOT {skip_sql("sentence")}),
firsts AS (SELECT *, row_number() OVER (PARTITION BY block_id, whole ORDER BY position) AS r FROM ruled WHERE rule IS NOT NULL AND whole <> ''),
found AS (SELECT block_id, position, rule, {truncated_sql("whole")} AS statement FROM firsts WHERE r = 1)
SELECT block_id, CAST(position AS INTEGER) AS position, {[k for k, _ in _KINDS]}[rule + 1] AS eiu_type, {[p for _, p in _KINDS]}[rule + 1] AS content_priority, block_id = min(block_id) OVER (PARTITION BY {_KEY}) AS is_questionable, md5(statement) AS text_md5, CAST(length(statement) AS INTEGER) AS n_chars FROM found
UNION ALL SELECT block_id, 0, 'rule', 'P2', false, md5('[排除] 无实质内容'), length('[排除] 无实质内容') FROM blocks WHERE block_id NOT IN (SELECT block_id FROM found)""")
def wfl04_extraction(s: SparkSession, d: str) -> DataFrame:
    blocks = parsed_blocks(s, d).select((F.col("document_id") * 100_000 + F.col("position")).alias("block_id"), "block_type", F.col("text").alias("block_text"))
    return X.extracted(blocks).select("block_id", "position", "eiu_type", "content_priority", "is_questionable", F.md5("statement").alias("text_md5"), F.length("statement").alias("n_chars"))


TOP = """SELECT a.item_id AS query_id, b.item_id, round(list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 6) AS score,
row_number() OVER (PARTITION BY a.item_id ORDER BY list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) DESC, b.item_id) AS rank FROM v_vector a JOIN v_vector b ON a.item_id <> b.item_id WHERE a.item_id % 100 = 0"""


@query(f"SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM ({TOP}) WHERE rank <= 5", "vector")
def top01_vector_search(s: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id 100 divides, a stated set; all vectors are searched, and 5 is the report's k."""
    items = T.indexed(view(s, d, "vector"), 64, "vector").select("item_id", "vector")
    queries = items.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vector")
    return T.top_k(queries, items, 5).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, item_id, similarity FROM (SELECT query_id, item_id, round(score, 4) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id DESC) AS r FROM ({TOP}) WHERE score >= 0.3) WHERE r = 1", "vector")
def top04_reuse(s: SparkSession, d: str) -> DataFrame:
    items = view(s, d, "vector").select("item_id", "vector")
    return T.best_reuse(items.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vector"), items, 0.3)


QUESTION = "the and that of with there"


@query(f"""WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda x: lower(x))) AS token FROM documents), n AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY doc_id, token),
s AS (SELECT doc_id, sum(CASE WHEN list_contains(string_split('{QUESTION}', ' '), token) THEN n END) AS shared, count(CASE WHEN list_contains(string_split('{QUESTION}', ' '), token) THEN 1 END) AS overlap, sqrt(sum(n * n)) AS norm FROM n GROUP BY doc_id)
SELECT doc_id AS block_id, coalesce(round(coalesce(shared / (norm * sqrt(6.0)), 0.0) + overlap * 0.1, 4), 0.0) AS score FROM documents LEFT JOIN s USING (doc_id)""")
def top05_lexical(s: SparkSession, d: str) -> DataFrame:
    blocks = view(s, d, "text").select(F.col("document_id").alias("block_id"), F.col("text").alias("block_text"))
    return T.lexical(QUESTION, blocks).select("block_id", "score")


@query("""WITH RECURSIVE o AS (SELECT vec_id AS item_id, label AS grp, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
g AS (SELECT grp, rn, item_id, true AS kept, [v] AS held FROM o WHERE rn = 1
UNION ALL SELECT o.grp, o.rn, o.item_id, NOT h.hit, CASE WHEN h.hit THEN g.held ELSE list_append(g.held, o.v) END FROM g JOIN o ON o.grp = g.grp AND o.rn = g.rn + 1,
LATERAL (SELECT len(list_filter(g.held, lambda x: list_inner_product(x, o.v) >= 0.4)) > 0 AS hit) h) SELECT item_id, kept FROM g""")
def win07_greedy_dedup(s: SparkSession, d: str) -> DataFrame:
    return X.greedy_dedup(view(s, d, "vector"), threshold=0.4)


SAMPLES = """, samples AS (SELECT 'doc_' || CAST(case_id AS STRING) AS case_uid, 'doc_generated' AS source, question, gold_answer, difficulty, CAST(NULL AS STRING) AS dimension, 7 AS ref FROM v_case WHERE review_status = 'quality_verified'
UNION ALL SELECT 'up_' || CAST(case_id AS STRING), 'uploaded', q, a, NULL, dimension, set_id FROM v_upload UNION ALL SELECT 'pub_' || CAST(case_id AS STRING), 'public', q, a, NULL, dimension, set_id FROM v_public),
items AS (SELECT * FROM (VALUES (1, 'doc_generated', 7, NULL), (2, 'uploaded', 1, 'user'), (3, 'uploaded', 2, NULL), (4, 'public', 0, 'even')) t(item_pos, source, ref, dim)) """
SAMPLE = ["case_uid", "source", "question", "gold_answer", "difficulty", "dimension"]
_SAMPLE = ", ".join(f"s.{c}" for c in SAMPLE)


def composition(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = [(1, "doc_generated", 7, None, None), (2, "uploaded", None, 1, "user"), (3, "uploaded", None, 2, None), (4, "public", None, 0, "even")]
    items = s.createDataFrame(rows, "item_pos int, source string, version_id long, set_id long, dimension string")
    native = V.publishable(view(s, d, "case")).withColumn("version_id", F.lit(7))
    return items, U.samples(native, view(s, d, "upload"), view(s, d, "public"))


@query(SAMPLES + f"""SELECT i.item_pos, {_SAMPLE} FROM items j JOIN samples s ON s.source = j.source AND s.ref = j.ref JOIN items i ON i.source = s.source WHERE i.dim IS NULL OR i.dim = s.dimension""", "case", "upload", "public")
def jn14_composition(s: SparkSession, d: str) -> DataFrame:
    return U.composed(*composition(s, d)).select("item_pos", *SAMPLE)


@query(SAMPLES + f"""SELECT i.item_pos, {_SAMPLE} FROM items i JOIN samples s ON s.source = i.source AND s.ref = i.ref WHERE i.dim IS NULL OR i.dim = s.dimension""", "case", "upload", "public")
def jn14_distinct_composition(s: SparkSession, d: str) -> DataFrame:
    return U.composed(*composition(s, d), distinct_sets=True).select("item_pos", *SAMPLE)


@query("""SELECT 'doc_' || CAST(case_id AS STRING) AS case_uid, 'doc_generated' AS source, question, gold_answer, difficulty, CAST(NULL AS STRING) AS dimension FROM v_case
UNION ALL SELECT 'up_' || CAST(case_id AS STRING), 'uploaded', q, a, NULL, dimension FROM v_upload UNION ALL SELECT 'pub_' || CAST(case_id AS STRING), 'public', q, a, NULL, dimension FROM v_public""", "case", "upload", "public")
def set01_union_all(s: SparkSession, d: str) -> DataFrame:
    return U.samples(view(s, d, "case").withColumn("version_id", F.lit(7)), view(s, d, "upload"), view(s, d, "public")).select(*SAMPLE)


FOLDERS = """WITH RECURSIVE folders AS (SELECT CAST(r_regionkey AS BIGINT) AS folder_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM region
UNION ALL SELECT 100 + n_nationkey, CAST(CASE WHEN n_nationkey % 4 = 3 THEN 99 + n_nationkey ELSE n_regionkey END AS BIGINT), n_name FROM nation),
tree AS (SELECT folder_id, name AS path, 1 AS depth FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.folder_id, t.path || '/' || f.name, t.depth + 1 FROM folders f JOIN tree t ON f.parent_id = t.folder_id) """


def folders(s: SparkSession, d: str) -> DataFrame:
    roots = s.read.parquet(f"{d}/region.parquet").selectExpr("CAST(r_regionkey AS BIGINT) AS folder_id", "CAST(NULL AS BIGINT) AS parent_id", "r_name AS name")
    below = s.read.parquet(f"{d}/nation.parquet").selectExpr(
        "CAST(100 + n_nationkey AS BIGINT) AS folder_id", "CAST(CASE WHEN n_nationkey % 4 = 3 THEN 99 + n_nationkey ELSE n_regionkey END AS BIGINT) AS parent_id", "n_name AS name"
    )
    return roots.unionByName(below)


@query(FOLDERS + "SELECT folder_id, path, depth FROM tree")
def hie05_folder_paths(s: SparkSession, d: str) -> DataFrame:
    return D.with_paths(folders(s, d)).select("folder_id", "path", "depth")


@query(FOLDERS + "SELECT folder_id, path FROM tree WHERE path = 'AFRICA' OR starts_with(path, 'AFRICA/')")
def hie01_descendants(s: SparkSession, d: str) -> DataFrame:
    return D.descendants(D.with_paths(folders(s, d)), "AFRICA").select("folder_id", "path")


@query("SELECT case_id, CASE WHEN folder_path = 'A/B' THEN 'X' WHEN starts_with(folder_path, 'A/B/') THEN 'X' || substr(folder_path, 4) ELSE folder_path END AS folder_path FROM v_case", "case")
def hie02_folder_move(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "case").select("case_id", D.moved(F.col("folder_path"), "A/B", "X").alias("folder_path"))


@query("SELECT document_id, CASE WHEN folder_path = 'A/B' THEN 'A' WHEN starts_with(folder_path, 'A/B/') THEN 'A/' || substr(folder_path, 5) ELSE folder_path END AS folder_path FROM v_document", "document")
def hie03_folder_delete(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "document").select("document_id", D.lifted(F.col("folder_path"), "A/B").alias("folder_path"))


@query("SELECT document_id, sha256(text) AS content_hash FROM v_text", "text")
def str11_content_hash(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "text").select("document_id", F.sha2("text", 256).alias("content_hash"))


@query(f"SELECT document_id, lower(regexp_replace(regexp_replace(text, '{SPACE}', '', 'g'), '[' || chr(39) || '，。？、；：,.?!;:\"“”‘’（）()【】\\[\\]·…—\\-_/\\\\~`@#$^&*+=<>|]', '', 'g')) AS question_key FROM v_text", "text")
def str02_question_key(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "text").select("document_id", text.question_key(F.col("text")).alias("question_key"))


@query(f"SELECT document_id, regexp_replace(lower(text), '{SPACE}', '', 'g') AS answer_key FROM v_text", "text")
def str03_answer_key(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "text").select("document_id", text.answer_key(F.col("text")).alias("answer_key"))


@query("SELECT eiu_id, CASE WHEN eiu_id % 3 = 0 THEN 'blocked' ELSE review_status END AS review_status, is_questionable AND eiu_id % 3 <> 0 AS is_questionable FROM v_eiu", "eiu")
def snk13_soft_delete(s: SparkSession, d: str) -> DataFrame:
    eiu = view(s, d, "eiu")
    return C.blocked(eiu, eiu.where("eiu_id % 3 = 0")).select("eiu_id", "review_status", "is_questionable")


@query("SELECT case_id, CASE WHEN case_id % 5 = 0 THEN 'edited' ELSE question END AS question, CASE WHEN case_id % 5 = 0 AND review_status <> 'retired' THEN 'candidate' ELSE review_status END AS review_status FROM (SELECT case_id, CASE WHEN review_status = 'retired' AND case_id % 5 = 0 THEN question ELSE question END AS question, review_status FROM v_case WHERE review_status <> 'retired')", "case")
def snk12_patches(s: SparkSession, d: str) -> DataFrame:
    live = view(s, d, "case").where("review_status <> 'retired'")
    return C.revised(live, live.where("case_id % 5 = 0").select("case_id", F.lit("edited").alias("question")))[0].select("case_id", "question", "review_status")


@query("SELECT eiu_id FROM v_eiu WHERE block_id NOT IN (SELECT block_id FROM v_block WHERE document_id = 4)", "eiu", "block")
def snk15_cascade_delete(s: SparkSession, d: str) -> DataFrame:
    eiu, blocks = view(s, d, "eiu"), view(s, d, "block")
    tables = view(s, d, "document"), blocks, eiu, view(s, d, "case"), checks(s, d)
    return C.without_document(4, *tables)[2].select("eiu_id")


@query("SELECT 'cases' AS kind, case_id FROM v_case WHERE document_id <> 4 UNION ALL SELECT DISTINCT 'checks', case_id FROM v_checks WHERE case_id NOT IN (SELECT case_id FROM v_case WHERE document_id = 4)", "case", "checks")
def snk15_cascade_cases(s: SparkSession, d: str) -> DataFrame:
    tables = view(s, d, "document"), view(s, d, "block"), view(s, d, "eiu"), view(s, d, "case"), checks(s, d)
    _, _, _, cases, left = C.without_document(4, *tables)
    return cases.select(F.lit("cases").alias("kind"), "case_id").unionByName(left.select(F.lit("checks").alias("kind"), "case_id").distinct())


@query("""SELECT block_id, statement, CASE content_priority WHEN 'P0' THEN 5 WHEN 'P1' THEN 3 ELSE 1 END AS weight, document_id, NOT is_questionable AND exclusion_reason IS NULL AS refused FROM (
SELECT *, row_number() OVER (PARTITION BY block_id, statement ORDER BY eiu_id) AS r FROM v_eiu) e LEFT JOIN v_block b USING (block_id) WHERE r = 1""", "eiu", "block")
def snk11_inserted_statements(s: SparkSession, d: str) -> DataFrame:
    items = view(s, d, "eiu").withColumns({"position": F.col("eiu_id"), "evidence_blocks": F.lit(None).cast("array<bigint>")}).drop("weight")
    return C.inserted_statements(items, view(s, d, "block")).select("block_id", "statement", "weight", "document_id", F.col("problem").isNotNull().alias("refused"))


@query("SELECT case_id, eiu_id, question, gold_answer, row_number() OVER (ORDER BY case_id) AS new_id FROM v_case", "case")
def snk09_numbered(s: SparkSession, d: str) -> DataFrame:
    return C.numbered(view(s, d, "case").select("case_id", "eiu_id", "question", "gold_answer"), "new_id", F.col("case_id"))


@query("""SELECT document_id, max(CASE WHEN r = 1 THEN case_id END) AS latest_case FROM (SELECT document_id, case_id, row_number() OVER (PARTITION BY document_id ORDER BY case_id DESC) AS r FROM v_case) GROUP BY document_id""", "case")
def top07_latest(s: SparkSession, d: str) -> DataFrame:
    return L.latest_of(view(s, d, "case"), "document_id", "case_id").withColumnRenamed("case_id", "latest_case")


@query("SELECT document_id, CAST(count(DISTINCT c.eiu_id) AS BIGINT) AS statements, CAST(count(*) AS BIGINT) AS cases FROM v_case c WHERE review_status <> 'retired' GROUP BY document_id", "case")
def jn16_per_document(s: SparkSession, d: str) -> DataFrame:
    return L.cases_by_document(C.filter_cases(view(s, d, "case")))


@query("""SELECT conv_id, turn AS last_turn, text AS q FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""")
def prj08_final_turn(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/conversations.parquet")
    turn = F.struct(F.col("turn"), F.col("text").alias("q"), F.col("role").alias("a"))
    cases = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumns({"q": F.lit(""), "a": F.lit("")})
    return U.lifted(cases).select("conv_id", F.try_element_at("turns", F.lit(-1))["turn"].alias("last_turn"), "q")


@query("SELECT eiu_id, first_block FROM (SELECT eiu_id, CASE WHEN EXISTS (SELECT 1 FROM v_block b WHERE b.block_id = e.block_id AND b.block_type <> 'title') THEN block_id ELSE block_id + 1 END AS first_block FROM v_eiu e) WHERE first_block IN (SELECT block_id FROM v_block)", "eiu", "block")
def win03_source_block(s: SparkSession, d: str) -> DataFrame:
    """The first evidence block that exists and is no title, else the next one."""
    listed = view(s, d, "eiu").select("eiu_id", F.array("block_id", F.col("block_id") + 1).alias("evidence_blocks"))
    return G.usable_source(listed, view(s, d, "block")).withColumnRenamed("block_id", "first_block")
