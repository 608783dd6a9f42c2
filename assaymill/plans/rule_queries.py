"""Registered queries of rules on texts and numbers, and of smaller operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions import records, scoring, text
from assaymill.operators import adapters as A
from assaymill.operators import cases as C
from assaymill.operators import coverage as V
from assaymill.operators import evaluate as E
from assaymill.operators import extraction as X
from assaymill.operators import generation as G
from assaymill.operators import ingest as I
from assaymill.operators import quality as Q
from assaymill.operators import vectors as T
from assaymill.plans.queries import _KINDS, RESULTS, SPACE, W, classified_sql, covering, query, report_tables, scored_results, skip_sql, trim_sql, truncated_sql
from assaymill.plans.views import checks, view
from assaymill.sources import readers, writers


def phrases(s: SparkSession, d: str, **columns) -> DataFrame:
    return view(s, d, "phrase").select("phrase_id", *[c.alias(n) for n, c in columns.items()])


def phrase() -> Column:
    return F.col("phrase")


_NUMBERED = "regexp_replace(" + trim_sql("phrase") + r", '^(?:\(?[0-9０-９]+\)?[.、]\s*)+', '')"


@query(f"SELECT phrase_id, lower({trim_sql(f'''regexp_replace({_NUMBERED}, '({W}|[。；;，,、])+$', '')''')}) AS key FROM v_phrase", "phrase")
def str01_statement_key(s: SparkSession, d: str) -> DataFrame:
    return phrases(s, d, key=text.statement_key(phrase()))


SOME = "[^" + W[1:]
_PREFIX = f"^(?:[（(]{W}*[一二三四五六七八九十0-9]+{W}*[）)]|[①②③④⑤⑥⑦⑧⑨⑩]+|[0-9]+{W}*[、.．])"
_BARE = trim_sql(f"regexp_replace({trim_sql('phrase')}, '{_PREFIX}', '')")


@query(f"SELECT phrase_id, {trim_sql(f'''regexp_replace({_BARE}, '({W}|[。；;])+$', '')''')} AS statement FROM v_phrase", "phrase")
def str04_cleaned(s: SparkSession, d: str) -> DataFrame:
    return phrases(s, d, statement=text.cleaned_statement(phrase()))


@query(f"SELECT phrase_id, {truncated_sql('repeat(phrase, 30)')} AS cut FROM v_phrase", "phrase")
def str05_truncated(s: SparkSession, d: str) -> DataFrame:
    return phrases(s, d, cut=text.truncated(F.repeat(phrase(), F.lit(30))))


@query(f"SELECT phrase_id, array_to_string(list_filter(list_transform(regexp_split_to_array(phrase, '[。；;\\n]+'), lambda x: {trim_sql('x')}), lambda x: x <> ''), '|') AS sentences FROM v_phrase", "phrase")
def str06_sentences(s: SparkSession, d: str) -> DataFrame:
    return phrases(s, d, sentences=F.array_join(text.sentences(phrase()), "|"))


@query(f"SELECT phrase_id, {[k for k, _ in _KINDS]}[{classified_sql('phrase')} + 1] AS kind, {[p for _, p in _KINDS]}[{classified_sql('phrase')} + 1] AS priority FROM v_phrase", "phrase")
def str07_classified(s: SparkSession, d: str) -> DataFrame:
    kind = text.classified(phrase())
    return phrases(s, d, kind=kind["eiu_type"], priority=kind["content_priority"])


def _first_sql(words: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains(phrase, '{w}') THEN '{w}' END" for w in words) + ")"


_CONDITION = f"nullif(regexp_extract(phrase, '{S.CONDITION}', 1), '')"


@query(f"""SELECT phrase_id, {_first_sql(S.UNITS)} AS unit, {_first_sql(S.CURRENCIES)} AS currency, nullif(regexp_extract(phrase, '([0-9]{{4}}年)', 1), '') AS period,
nullif(regexp_extract(phrase, '{S.SUBJECT}', 1), '') AS subject, CASE WHEN length({_CONDITION}) <= 40 THEN {_CONDITION} END AS condition FROM v_phrase""", "phrase")
def str08_constraints(s: SparkSession, d: str) -> DataFrame:
    c = text.constraints(phrase())
    return phrases(s, d, **{n: c[n] for n in ("unit", "currency", "period", "subject", "condition")})


@query(r"SELECT phrase_id, array_to_string(list_transform(regexp_extract_all(phrase, '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda x: lower(x)), '|') AS tokens FROM v_phrase", "phrase")
def str09_tokens(s: SparkSession, d: str) -> DataFrame:
    return phrases(s, d, tokens=F.array_join(text.tokens(phrase()), "|"))


@query(rf"""SELECT phrase_id, CASE WHEN regexp_matches(t, '^#{{1,6}}{W}+{SOME}') THEN 'title' WHEN t = '' THEN NULL WHEN regexp_matches(t, '^([-*+]|[0-9]+[.)]){W}+') THEN 'list_item' ELSE 'paragraph' END AS kind,
CASE WHEN regexp_matches(t, '^#{{1,6}}{W}+{SOME}') THEN CAST(length(regexp_extract(t, '^(#+)', 1)) AS INTEGER) END AS level, nullif(CASE WHEN regexp_matches(t, '^#{{1,6}}{W}+{SOME}') THEN {trim_sql("regexp_replace(t, '^#+', '')")} ELSE t END, '') AS text
FROM (SELECT phrase_id, {trim_sql('phrase')} AS t FROM v_phrase)""", "phrase")
def str10_line_kinds(s: SparkSession, d: str) -> DataFrame:
    k = text.line_kind(phrase())
    return phrases(s, d, kind=k["block_type"], level=k["level"], text=k["text"])


@query("""SELECT phrase_id, array_to_string(CASE WHEN NOT json_valid(phrase) THEN [] WHEN json_type(phrase) = 'ARRAY' THEN json_extract_string(phrase, '$[*].statement') WHEN json_type(phrase) = 'OBJECT' THEN json_extract_string(phrase, '$.items[*].statement') ELSE [] END, '|') AS statements FROM v_phrase""", "phrase")
def str12_replies(s: SparkSession, d: str) -> DataFrame:
    """Replies of every odd phrase stand in a code fence."""
    fenced = F.when(F.col("phrase_id") % 32 < 16, F.concat(F.lit("```json\n"), phrase(), F.lit("\n```"))).otherwise(phrase())
    return phrases(s, d, statements=F.array_join(F.transform(text.json_list(fenced, "struct<statement:string>"), lambda x: x["statement"]), "|"))


@query("""SELECT phrase_id, CASE WHEN json_valid(r) THEN coalesce(json_extract_string(r, '$.output'), json_extract_string(r, '$.choices[0].message.content'), json_extract_string(r, '$.choices[0].text'), r) ELSE r END AS reply
FROM (SELECT phrase_id, CASE phrase_id % 4 WHEN 0 THEN CAST(json_object('output', phrase) AS VARCHAR) WHEN 1 THEN CAST(json_object('choices', json_array(json_object('message', json_object('content', phrase)))) AS VARCHAR)
WHEN 2 THEN CAST(json_object('choices', json_array(json_object('text', phrase))) AS VARCHAR) ELSE phrase END AS r FROM v_phrase)""", "phrase")
def str13_reply_text(s: SparkSession, d: str) -> DataFrame:
    k = F.col("phrase_id") % 4
    shapes = F.when(k == 0, F.to_json(F.struct(phrase().alias("output")))).when(k == 1, F.to_json(F.struct(F.array(F.struct(F.struct(phrase().alias("content")).alias("message"))).alias("choices"))))
    return phrases(s, d, reply=text.reply_text(shapes.when(k == 2, F.to_json(F.struct(F.array(F.struct(phrase().alias("text"))).alias("choices")))).otherwise(phrase())))


@query(f"SELECT phrase_id, {skip_sql('phrase')} AS skip FROM v_phrase", "phrase")
def flt08_skipped(s: SparkSession, d: str) -> DataFrame:
    return phrases(s, d, skip=text.skippable(phrase()))


@query("SELECT event_id, greatest(0.0, least(1.0, value / 50.0)) AS confidence, CASE WHEN user_id = 0 THEN 0 ELSE CAST(round(event_id % 7 * 100.0 / user_id) AS INTEGER) END AS progress FROM events")
def mth01_numbers(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", scoring.confidence(F.col("value") / 50).alias("confidence"), scoring.progress(F.col("event_id") % 7, F.col("user_id")).alias("progress"))


@query("""SELECT a.item_id, round(list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 6) AS cosine FROM v_vector a JOIN v_vector b ON b.item_id = a.item_id - a.item_id % 100""", "vector")
def mth02_cosine(s: SparkSession, d: str) -> DataFrame:
    a = view(s, d, "vector")
    b = a.select(F.col("item_id").alias("other"), F.col("vector").alias("v"))
    return a.join(b, F.col("other") == F.col("item_id") - F.col("item_id") % 100).select("item_id", F.round(scoring.cosine(F.col("vector"), F.col("v")), 6).alias("cosine"))


def _advice_sql(code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ADVICE.items()) + f" ELSE '{S.NO_ADVICE}' END"


@query(RESULTS + f"SELECT result_id, {_advice_sql('diagnosis')} AS suggestion FROM r WHERE diagnosis IS NOT NULL AND status IN ('failed', 'error')")
def scr04_suggestions(s: SparkSession, d: str) -> DataFrame:
    return E.error_book(scored_results(s, d)).select("result_id", "suggestion")


@query("SELECT c.case_id, check_type, passed FROM v_checks k JOIN v_case c ON c.case_id = 1000 * k.case_id + 1 WHERE review_status <> 'retired' AND document_id = 3", "checks", "case")
def jn03_checks_of_document(s: SparkSession, d: str) -> DataFrame:
    rows = checks(s, d).withColumn("case_id", F.col("case_id") * 1000 + 1)
    return Q.checks_of(rows, view(s, d, "case"), 3).select("case_id", "check_type", "passed")


@query(""", q AS (SELECT block_id, block_text, CASE WHEN block_id % 6 = 5 THEN ' ' ELSE 'point' END AS point, right(CAST(block_id * 37 AS STRING), 2) AS quote FROM v_block)
SELECT block_id AS case_id, strpos(block_text, quote) = 0 OR trim(point) = '' AS falls_back, CASE WHEN strpos(block_text, quote) > 0 AND trim(point) <> '' THEN CAST(strpos(block_text, quote) - 1 AS INTEGER) END AS start_offset,
CASE WHEN strpos(block_text, quote) > 0 AND trim(point) <> '' THEN CAST(strpos(block_text, quote) - 1 + length(quote) AS INTEGER) END AS end_offset FROM q""", "block")
def jn12_evidence(s: SparkSession, d: str) -> DataFrame:
    """Quotes of two digits, which some blocks hold and others don't, and some points without a text."""
    blocks, k = view(s, d, "block"), F.col("block_id")
    quote = F.right((k * 37).cast("string"), F.lit(2))
    points = blocks.select(k.alias("case_id"), "document_id", "block_id", F.when(k % 6 == 5, " ").otherwise("point").alias("must_have_point"), quote.alias("original_text"))
    first = F.element_at("points", 1)
    return G.evidence(points, blocks).select("case_id", "falls_back", first["start_offset"].alias("start_offset"), first["end_offset"].alias("end_offset"))


@query("SELECT case_id, substr(statement || chr(10) || 'q1' || chr(10) || 'q2', 1, 500) AS context FROM v_case JOIN v_eiu USING (eiu_id)", "case", "eiu")
def jn15_context(s: SparkSession, d: str) -> DataFrame:
    return G.checking_context(view(s, d, "case").withColumn("quotes", F.array(F.lit("q1"), F.lit("q2"))), view(s, d, "eiu"))


@query("SELECT CAST(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS generated, CAST(sum(CASE WHEN error IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM v_result", "result")
def agg26_results(s: SparkSession, d: str) -> DataFrame:
    return G.results(view(s, d, "result"))


@query("SELECT case_id FROM v_case WHERE case_id NOT IN (SELECT case_id FROM v_case WHERE eiu_id % 5 = 0)", "case")
def snk14_deleted(s: SparkSession, d: str) -> DataFrame:
    cases = view(s, d, "case")
    return C.without(cases, cases.where("eiu_id % 5 = 0"), "case_id").select("case_id")


@query("SELECT case_id, check_type, passed FROM v_checks WHERE case_id % 3 <> 0 UNION ALL SELECT DISTINCT case_id, 'answerability', true FROM v_checks WHERE case_id % 3 = 0", "checks")
def snk16_replaced_checks(s: SparkSession, d: str) -> DataFrame:
    old = checks(s, d)
    new = old.where("case_id % 3 = 0").select("case_id").distinct().select("case_id", F.lit("answerability").alias("check_type"), F.lit(True).alias("passed"), F.lit("").alias("reason"))
    return C.replaced_checks(old, new).select("case_id", "check_type", "passed")


@query("""SELECT CAST(to_json({'case_id': printf('case_%04d_%06d', 7, case_id), 'question': question, 'gold_answer': gold_answer, 'evidence': NULL}) AS STRING) AS value FROM v_case WHERE review_status <> 'retired'""", "case")
def snk01_jsonl(s: SparkSession, d: str) -> DataFrame:
    uid = F.format_string("case_%04d_%06d", F.lit(7), "case_id")
    cases = view(s, d, "case").withColumns({"case_uid": uid, "retired": F.col("review_status") == "retired", "evidence": F.lit(None).cast("string")})
    return writers.jsonl_rows(cases, limit=None)


@query("""SELECT d.file_name AS document_name, b.section_path, CAST(count(*) AS BIGINT) AS n, md5(string_agg(c.case_id || ':' || question || ':' || gold_answer, '|' ORDER BY CAST(c.case_id AS VARCHAR), question)) AS cases_md5 FROM v_case c JOIN v_eiu e USING (eiu_id) JOIN v_block b USING (block_id) JOIN v_document d ON d.document_id = b.document_id GROUP BY 1, 2""", "case", "eiu", "block", "document")
def snk02_nested(s: SparkSession, d: str) -> DataFrame:
    eiu = V.active(view(s, d, "eiu").withColumn("review_status", F.lit("candidate")), view(s, d, "block"), view(s, d, "document"))
    cases = view(s, d, "case").select(F.col("case_id").cast("string").alias("case_uid"), "question", "gold_answer", F.array("eiu_id").alias("eiu_ids"))
    rows = writers.nested(cases, eiu).select("document_name", F.explode("sections").alias("x"))
    text = F.array_join(F.transform("x.cases", lambda c: F.concat_ws(":", c["case_uid"], c["question"], c["gold_answer"])), "|")
    return rows.select("document_name", "x.section_path", F.size("x.cases").cast("long").alias("n"), F.md5(text).alias("cases_md5"))


@query("SELECT eiu_id, b.document_id, CAST(NULL AS STRING) AS tag FROM v_eiu LEFT JOIN v_block b USING (block_id)", "eiu", "block")
def snk19_migrated(s: SparkSession, d: str) -> DataFrame:
    wanted = s.createDataFrame([], "eiu_id long, block_id long, document_id long, tag string")
    return writers.migrated(view(s, d, "eiu"), wanted, view(s, d, "block")).select("eiu_id", "document_id", "tag")


UPLOADS = """(SELECT o_orderkey AS upload_id, 'h' || o_custkey % 40 AS file_hash, coalesce(n_name, 'new') AS file_name, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A/B' ELSE '' END AS folder_path FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 30)"""


@query(f""", u AS {UPLOADS}, k AS (SELECT *, 'h' || document_id AS file_hash FROM v_document), s AS (SELECT upload_id, CASE WHEN file_hash IN (SELECT file_hash FROM k) THEN 'duplicate' WHEN EXISTS (SELECT 1 FROM k WHERE k.file_name = u.file_name AND k.folder_path = u.folder_path) THEN 'conflict'
WHEN file_name IN (SELECT file_name FROM k) THEN 'elsewhere' ELSE 'ok' END AS status FROM u) SELECT upload_id, status, CASE status WHEN 'duplicate' THEN 'skip' WHEN 'ok' THEN 'direct' ELSE 'confirm' END AS action FROM s""", "document")
def wfl20_triaged(s: SparkSession, d: str) -> DataFrame:
    """An upload of each order, with contents, names and folders of which some are known."""
    k = F.col("o_orderkey")
    names = s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 0).alias("n"), "n_name")
    uploads = s.read.parquet(f"{d}/orders.parquet").join(names, F.col("n") == k % 30, "left").select(
        k.alias("upload_id"), F.concat(F.lit("h"), F.col("o_custkey") % 40).alias("file_hash"), F.coalesce("n_name", F.lit("new")).alias("file_name"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "A/B").otherwise("").alias("folder_path")
    )
    known = view(s, d, "document").withColumn("file_hash", F.concat(F.lit("h"), F.col("document_id").cast("string")))
    return I.triaged(I.prechecked(uploads, known)).select("upload_id", "status", "action")


@query("SELECT block_id, CASE WHEN block_id % 3 = 0 THEN 'asked ' || block_id ELSE block_text END AS source_text FROM v_block", "block")
def wfl05_source_text(s: SparkSession, d: str) -> DataFrame:
    k = F.col("block_id") % 3
    rows = view(s, d, "block").withColumns({"block_type": F.when(k < 2, "excel_row").otherwise("paragraph"), "question": F.when(k != 1, F.concat(F.lit("asked "), F.col("block_id").cast("string"))).otherwise("")})
    return X.source_text(rows).select("block_id", "source_text")


@query("""WITH a AS (SELECT doc_id AS origin_id, attempt, 10 * doc_id + attempt AS case_id FROM labels, (SELECT unnest([1, 2, 3]) AS attempt)),
c AS (SELECT case_id, CASE WHEN (origin_id * 7 + attempt * 5 + k) % 4 = 0 THEN false ELSE true END AS passed FROM a, (SELECT unnest([0, 1]) AS k)), g AS (SELECT origin_id, attempt, case_id FROM a WHERE attempt <= 2 AND case_id NOT IN (SELECT case_id FROM c WHERE NOT passed))
SELECT origin_id AS case_id, arg_min(case_id, attempt) AS replaced_by FROM g GROUP BY origin_id""")
def wfl08_regenerated(s: SparkSession, d: str) -> DataFrame:
    """Three attempts at new angles, each checked twice: the first of two that passes both counts, a third one is too late."""
    cases = checks(s, d).select("case_id").distinct()
    attempts = cases.select(F.col("case_id").alias("origin_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt")).withColumn("case_id", F.col("origin_id") * 10 + F.col("attempt"))
    passed = (F.col("origin_id") * 7 + F.col("attempt") * 5 + F.col("k")) % 4 != 0
    judged = attempts.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("case_id", F.when(F.col("k") == 0, "faithfulness").otherwise("uniqueness").alias("check_type"), passed.alias("passed"), F.lit("").alias("reason"))
    return Q.regenerated(cases, attempts, judged)


@query(*covering("""SELECT CAST(n AS BIGINT) AS total_eiu, CAST(q AS BIGINT) AS questionable_eiu, CAST(np AS INTEGER) AS priorities, CAST(nt AS INTEGER) AS types, w >= 0.85 AND p >= 1 AND r >= 1 AS gate_passed FROM (
SELECT count(*) AS n, count(CASE WHEN is_questionable THEN 1 END) AS q, count(DISTINCT content_priority) AS np, count(DISTINCT eiu_type) AS nt, round(sum(CASE WHEN is_questionable AND c THEN w ELSE 0 END) / CAST(sum(CASE WHEN is_questionable THEN w END) AS DOUBLE), 4) AS w,
round(sum(CASE WHEN is_questionable AND c AND content_priority = 'P0' THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN is_questionable AND content_priority = 'P0' THEN 1 END) AS DOUBLE), 4) AS p,
round(count(DISTINCT block_id) / CAST((SELECT count(*) FROM v_block WHERE block_type <> 'title') AS DOUBLE), 4) AS r FROM (
SELECT *, coalesce(weight, CASE content_priority WHEN 'P0' THEN 5 WHEN 'P1' THEN 3 ELSE 1 END) AS w, eiu_id IN (SELECT eiu_id FROM covered) AS c FROM active))"""))
def wfl17_report(s: SparkSession, d: str) -> DataFrame:
    """The whole report is one nested row, which is appended to the table of reports."""
    row = V.report(*report_tables(s, d))
    return row.select("total_eiu", "questionable_eiu", F.size("by_priority").alias("priorities"), F.size("by_type").alias("types"), "gate_passed")


@query("SELECT CAST(conv_id AS STRING) AS case_uid, 'mock: ' || arg_max(text, turn) AS answer, CAST(count(*) - 1 AS INTEGER) AS told FROM conversations GROUP BY conv_id")
def wfl13_run(s: SparkSession, d: str) -> DataFrame:
    """Each conversation's last turn, asked of the fixed adapter after the turns before it."""
    rows = s.read.parquet(f"{d}/conversations.parquet")
    turn = F.struct("turn", F.col("text").alias("q"), F.lit(False).alias("key_turn"))
    asked = A.asked_turns(rows.groupBy(F.col("conv_id").cast("string").alias("case_uid")).agg(F.sort_array(F.collect_list(turn)).alias("turns")))
    return A.answered(asked).join(asked.select("case_uid", F.size("history").alias("told")), "case_uid").select("case_uid", "answer", "told")


@query("SELECT DISTINCT custkey AS block_id, document_id FROM (SELECT c_custkey AS custkey, CAST(c_nationkey AS BIGINT) AS document_id FROM customer)")
def src07_seed_blocks(s: SparkSession, d: str) -> DataFrame:
    blocks = view(s, d, "block")
    return readers.seed_blocks(blocks.unionByName(blocks)).select("block_id", "document_id")


@query(f"SELECT item_id, round(score, 4) AS score FROM (SELECT b.item_id, list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) AS score FROM v_vector a JOIN v_vector b ON a.item_id = 100 AND b.item_id <> 100 AND b.grp = 3) ORDER BY score DESC, item_id LIMIT 7", "vector")
def top02_filtered(s: SparkSession, d: str) -> DataFrame:
    """Filtered first, then ranked; seven is the search's own size."""
    items = view(s, d, "vector")
    asked = items.where("item_id = 100").select(F.col("item_id").alias("query_id"), "vector")
    return T.top_k(asked, items.where("grp = 3").select("item_id", "vector"), 7, digits=4).select("item_id", "score")


@query("SELECT document_id, CASE WHEN n < 1024 THEN CAST(n AS STRING) || ' B' ELSE printf('%.1f KB', round(n / 1024.0, 1)) END AS size FROM (SELECT document_id, n_chars AS n FROM v_text)", "text")
def prj05_sizes(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "text").select("document_id", scoring.size_label(F.col("n_chars")).alias("size"))
