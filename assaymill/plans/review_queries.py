"""Registered queries of review: grids, rules as data, traces of evidence; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.operators import governance as G
from assaymill.operators import grid as D
from assaymill.operators import parsing as P
from assaymill.operators import tracing as T
from assaymill.plans.queries import query
from assaymill.plans.views import view

_SHOWN = "SELECT * FROM v_case WHERE (difficulty = 'L1' OR difficulty IS NULL) AND contains(lower(question), 'part 1') AND review_status IN ('quality_verified', 'candidate')"


def shown(s: SparkSession, d: str) -> DataFrame:
    return D.filtered(view(s, d, "case"), [("difficulty", "in", ["L1", None]), ("question", "contains", "Part 1"), ("review_status", "in", ["quality_verified", "candidate"])])


@query(f"""SELECT case_id, CAST(place AS BIGINT) AS place, CAST((place - 1) // 50 + 1 AS BIGINT) AS page FROM (SELECT case_id, row_number() OVER (ORDER BY difficulty DESC NULLS LAST, question, gold_answer DESC, case_id) AS place FROM ({_SHOWN}))""", "case")
def grd_pages(s: SparkSession, d: str) -> DataFrame:
    """All pages of a filtered and sorted grid; fifty rows is the size of a page."""
    return D.pages(shown(s, d), [("difficulty", False), ("question", True), ("gold_answer", False)], "case_id", 50).select("case_id", "place", "page")


@query(f""", r AS ({_SHOWN}), n AS (SELECT 'difficulty' AS dim, coalesce(difficulty, 'none') AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'review_status', coalesce(review_status, 'none'), count(*) FROM r GROUP BY 2
UNION ALL SELECT 'folder_path', coalesce(folder_path, 'none'), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*) FROM r) SELECT dim, value, CAST(n AS BIGINT) AS n, round(n / (SELECT count(*) FROM r), 6) AS share FROM n""", "case")
def grd_statistics(s: SparkSession, d: str) -> DataFrame:
    return D.statistics(shown(s, d), ["difficulty", "review_status", "folder_path"])


RULES = (
    G.Rule("R-BLANK", ("q", "a"), "blank"),
    G.Rule("R-STOP", ("a",), "lacks", r"[.!?]\s*$", severity="S1", action="revise"),
    G.Rule("R-TEXT", ("q", "a"), "matches", r"(?i)\bthe\b", unless=r"\band\b", severity="S2", action="warn"),
    G.Rule("R-SET", ("set_id",), "above", "4", severity="S1"),
    G.Rule("R-KIND", ("dimension",), "outside", values=("user", "assistant")),
    G.Rule("R-SAME", ("a",), "sql", "evidence = a AND length(a) > 200", severity="S2", action="shorten"),
)
_TESTS = {
    "R-BLANK": "trim(q) = '' AND trim(coalesce(a, '')) = ''", "R-STOP": r"NOT regexp_matches(coalesce(a, ''), '[.!?]\s*$')", "R-SET": "set_id > 4", "R-KIND": "coalesce(dimension, '') NOT IN ('user', 'assistant')",
    "R-TEXT": r"(regexp_matches(q, '(?i)\bthe\b') OR regexp_matches(coalesce(a, ''), '(?i)\bthe\b')) AND NOT (regexp_matches(q, '\band\b') OR regexp_matches(coalesce(a, ''), '\band\b'))", "R-SAME": "coalesce(evidence = a AND length(a) > 200, false)",
}
_CODES = "[" + ", ".join(f"CASE WHEN {_TESTS[r.code]} THEN '{r.code}' END" for r in RULES) + "]"
_BLOCKED = " OR ".join(f"({_TESTS[r.code]})" for r in RULES if r.severity == "S0")


@query(f"SELECT case_id, array_to_string(list_filter({_CODES}, lambda x: x IS NOT NULL), ',') AS codes, {_BLOCKED} AS blocked FROM v_upload", "upload")
def gov_violations(s: SparkSession, d: str) -> DataFrame:
    """A set of rules, given as data, on uploaded cases."""
    found = G.judged(view(s, d, "upload"), RULES)
    return found.select("case_id", F.array_join(F.transform("violations", lambda v: v["code"]), ",").alias("codes"), "blocked")


@query(" UNION ALL ".join(f"SELECT set_id, '{r.code}' AS code, '{r.severity}' AS severity, CAST(count(*) AS BIGINT) AS rows, CAST(count(CASE WHEN {_TESTS[r.code]} THEN 1 END) AS BIGINT) AS violations FROM v_upload GROUP BY set_id" for r in RULES), "upload")
def gov_report(s: SparkSession, d: str) -> DataFrame:
    return G.rule_report(G.judged(view(s, d, "upload"), RULES), RULES, ["set_id"]).drop("rate")


_LINES = """l AS (SELECT document_id, i, line, start, start + length(line) AS stop FROM (SELECT document_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM v_text)) WHERE trim(line) <> ''),
q AS (SELECT document_id, k, k * 500 AS start, least(k * 500 + 120, length(text)) AS stop FROM (SELECT document_id, text, unnest(range(CAST(ceil(length(text) / 500) AS BIGINT))) AS k FROM v_text)),
o AS (SELECT q.document_id, k, count(*) AS n_blocks, sum(least(q.stop, l.stop) - greatest(q.start, l.start)) AS covered FROM q JOIN l ON q.document_id = l.document_id AND l.start < q.stop AND q.start < l.stop GROUP BY 1, 2),
t AS (SELECT q.*, coalesce(n_blocks, 0) AS n_blocks, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CASE WHEN coalesce(covered, 0) = 0 THEN 'lost' WHEN covered = stop - start THEN 'traced' ELSE 'partial' END AS status FROM q LEFT JOIN o USING (document_id, k))"""


def traces(s: SparkSession, d: str) -> DataFrame:
    """Quotes of 120 characters at every 500 of each text, against its lines."""
    texts = view(s, d, "text").select("document_id", "text")
    lines = P.lines(texts).select("document_id", F.concat_ws(":", "document_id", "line_no").alias("block_id"), "start", "end")
    n = F.ceil(F.length("text") / 500)
    quotes = texts.select("document_id", F.length("text").alias("n"), F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))).alias("k"))
    start = F.col("k") * 500
    quotes = quotes.select(F.concat_ws(":", "document_id", "k").alias("quote_id"), "document_id", "k", start.alias("start"), F.least(start + 120, F.col("n")).cast("long").alias("end"))
    return T.traced(quotes, lines)


@query(f"WITH {_LINES.replace('v_text', '(SELECT doc_id AS document_id, text FROM documents)')} SELECT document_id, k, CAST(n_blocks AS BIGINT) AS n_blocks, covered, status FROM t")
def evd_traced(s: SparkSession, d: str) -> DataFrame:
    return traces(s, d).select("document_id", "k", "n_blocks", "covered", "status")


@query(f"""WITH {_LINES.replace('v_text', '(SELECT doc_id AS document_id, text FROM documents)')} SELECT lang, CAST(count(*) AS BIGINT) AS quotes, CAST(count(CASE WHEN status = 'traced' THEN 1 END) AS BIGINT) AS traced, CAST(count(CASE WHEN status = 'partial' THEN 1 END) AS BIGINT) AS partial,
CAST(count(CASE WHEN status = 'lost' THEN 1 END) AS BIGINT) AS lost, CAST(0 AS BIGINT) AS unlocated, round(count(CASE WHEN status = 'traced' THEN 1 END) / count(*), 4) AS traceability FROM t JOIN documents ON doc_id = document_id GROUP BY lang""")
def evd_rates(s: SparkSession, d: str) -> DataFrame:
    langs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"), "lang")
    return T.trace_rates(traces(s, d).join(langs, "document_id"), ["lang"])


@query("""SELECT CAST(count(CASE WHEN block_type = 'paragraph' THEN 1 END) AS BIGINT) AS paragraphs, CAST(count(CASE WHEN block_type = 'paragraph' AND has THEN 1 END) AS BIGINT) AS associated, round(count(CASE WHEN block_type = 'paragraph' AND has THEN 1 END) / count(CASE WHEN block_type = 'paragraph' THEN 1 END), 4) AS association_rate,
(SELECT CAST(count(*) AS BIGINT) FROM v_eiu) AS statements, (SELECT CAST(count(*) AS BIGINT) FROM v_eiu WHERE NOT is_questionable) AS excluded, (SELECT round(count(CASE WHEN NOT is_questionable THEN 1 END) / count(*), 4) FROM v_eiu) AS exclusion_rate
FROM (SELECT *, block_id IN (SELECT block_id FROM v_eiu) AS has FROM v_block)""", "block", "eiu")
def evd_association(s: SparkSession, d: str) -> DataFrame:
    return T.association(view(s, d, "block"), view(s, d, "eiu"))
