"""Registered queries of workflows: imports, compositions, releases, edits, folders, exports, models plugged in; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions import records, requests
from assaymill.operators import cases as C
from assaymill.operators import coverage as V
from assaymill.operators import editing as W
from assaymill.operators import evalsets as U
from assaymill.operators import extraction as X
from assaymill.operators import folders as D
from assaymill.operators import generation as G
from assaymill.operators import lookups as L
from assaymill.operators import releases as R
from assaymill.operators import vectors as T
from assaymill.plans.queries import FOLDERS, SPACE, folders, query, trim_sql, truncated_sql
from assaymill.plans.views import checks, view
from assaymill.sources import writers

SETS = "(SELECT CAST(n_nationkey AS BIGINT) AS set_id, n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'active' ELSE 'retired' END AS status, CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END AS enabled FROM nation)"


def sets(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/nation.parquet")
    return rows.selectExpr(
        "CAST(n_nationkey AS BIGINT) AS set_id", "n_name AS name", "CASE WHEN n_regionkey % 2 = 0 THEN 'active' ELSE 'retired' END AS status", "CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END AS enabled"
    )


@query(f"SELECT set_id, name FROM {SETS} WHERE status = 'active'")
def flt05_public_sets(s: SparkSession, d: str) -> DataFrame:
    return L.public_sets(sets(s, d)).select("set_id", "name")


@query(f"SELECT set_id AS dimension_id, name FROM {SETS} WHERE enabled = 1")
def flt05_dimensions(s: SparkSession, d: str) -> DataFrame:
    return L.enabled_dimensions(sets(s, d)).select(F.col("set_id").alias("dimension_id"), "name")


@query("SELECT case_id, question, difficulty FROM v_case WHERE contains(lower(question), 'part 7') AND coalesce(difficulty, '—') IN ('L1', '—')", "case")
def flt10_search(s: SparkSession, d: str) -> DataFrame:
    return L.with_values(L.searched(view(s, d, "case"), " PART 7", "question"), "difficulty", ["L1", S.DASH]).select("case_id", "question", "difficulty")


@query("SELECT DISTINCT coalesce(nullif(scope, ''), '—') AS value FROM v_case", "case")
def flt10_values(s: SparkSession, d: str) -> DataFrame:
    return L.values_of(view(s, d, "case"), "scope")


@query("SELECT CAST(ceil(count(*) / 15.0) AS INTEGER) AS pages FROM v_case", "case")
def flt10_pages(s: SparkSession, d: str) -> DataFrame:
    return L.pages(view(s, d, "case"))


def named_cases(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "case").join(view(s, d, "document").select("document_id", F.col("file_name").alias("document_name")), "document_id")


@query("SELECT c.case_id FROM v_case c JOIN v_document d ON d.document_id = c.document_id WHERE c.difficulty = 'L2' AND d.file_name = 'NATION_7'", "case", "document")
def flt11_listed_by_command(s: SparkSession, d: str) -> DataFrame:
    return L.commanded(named_cases(s, d), "列出 中等 问答对 NATION_7").select("case_id")


@query("SELECT case_id FROM v_case WHERE case_id <> 1001", "case")
def flt11_deleted_by_command(s: SparkSession, d: str) -> DataFrame:
    return L.deleted_by_command(view(s, d, "case"), "删除 q-1001").select("case_id")


@query("SELECT case_id, question FROM v_case WHERE case_id = 1001", "case")
def src10_case_by_key(s: SparkSession, d: str) -> DataFrame:
    return L.by_key(view(s, d, "case"), case_id=1001).select("case_id", "question")


@query("SELECT case_id, q FROM v_upload WHERE set_id = 3 ORDER BY case_id", "upload")
def flt13_cases_of_set(s: SparkSession, d: str) -> DataFrame:
    return L.of_parent(view(s, d, "upload"), "set_id", 3, "case_id").select("case_id", "q")


@query("SELECT document_id, file_name FROM v_document ORDER BY document_id DESC", "document")
def flt14_newest_documents(s: SparkSession, d: str) -> DataFrame:
    return L.newest(view(s, d, "document"), "document_id", limit=None).select("document_id", "file_name")


@query("SELECT case_id, CASE review_status WHEN 'candidate' THEN 0 ELSE 1 END AS turn FROM v_case WHERE review_status IN ('candidate', 'needs_review')", "case")
def set02_to_check(s: SparkSession, d: str) -> DataFrame:
    return L.to_check(view(s, d, "case")).select("case_id", "turn")


@query("""SELECT 'shared' AS kind, eiu_id FROM (SELECT eiu_id FROM v_eiu INTERSECT SELECT eiu_id FROM v_case WHERE review_status = 'candidate')
UNION ALL SELECT 'missing', eiu_id FROM (SELECT eiu_id FROM v_eiu EXCEPT SELECT eiu_id FROM v_case WHERE review_status = 'candidate')""", "eiu", "case")
def set03_differences(s: SparkSession, d: str) -> DataFrame:
    eiu, some = view(s, d, "eiu"), C.having(view(s, d, "case"), review_status="candidate")
    parts = [f(eiu, some, "eiu_id").select(F.lit(kind).alias("kind"), "eiu_id") for kind, f in (("shared", L.shared_keys), ("missing", L.missing_keys))]
    return parts[0].unionByName(parts[1])


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(list_intersect(list_transform(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'), lambda x: lower(x)), ['the', 'of', 'and']))), ' ') AS words FROM benchmark""")
def set03_shared_words(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/benchmark.parquet")
    return rows.select("item_id", F.array_join(L.shared_tokens(F.col("text"), F.lit("the of and")), " ").alias("words"))


@query("SELECT review_status, CAST(count(*) AS BIGINT) AS n FROM v_case GROUP BY review_status", "case")
def agg24_counts(s: SparkSession, d: str) -> DataFrame:
    return L.row_count(view(s, d, "case"), "review_status")


@query("""SELECT folder_path, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(CASE WHEN review_status = 'quality_verified' THEN 1 ELSE 0 END) * 100.0 / count(*)) AS INTEGER) AS passed_pct, 0 AS rejected_pct FROM v_case GROUP BY folder_path""", "case")
def agg25_review_shares(s: SparkSession, d: str) -> DataFrame:
    return D.shares(view(s, d, "case"), "folder_path")


@query("SELECT document_id, CASE WHEN document_id = 3 THEN 'X/Y' ELSE folder_path END AS folder_path, CASE WHEN document_id = 3 THEN 'basic' ELSE 'gen' END AS purpose, CASE WHEN document_id = 4 THEN 'new.md' ELSE file_name END AS file_name FROM v_document", "document")
def hie06_document_move(s: SparkSession, d: str) -> DataFrame:
    rows = W.moved_document(view(s, d, "document").withColumn("purpose", F.lit("gen")), 3, "/X/Y/")
    return W.renamed(rows, "document_id", 4, "file_name", " new.md ").select("document_id", "folder_path", "purpose", "file_name")


@query("SELECT case_id, CASE WHEN case_id = 1001 THEN 'Z' ELSE folder_path END AS folder_path FROM v_case WHERE document_id <> 2", "case")
def wfl19_case_routes(s: SparkSession, d: str) -> DataFrame:
    return W.without_cases(W.moved_case(view(s, d, "case"), 1001, "Z"), document_id=2).select("case_id", "folder_path")


@query(FOLDERS + "SELECT path, depth FROM tree UNION ALL VALUES ('AFRICA/NEW', 2), ('AFRICA/NEW/DEEP', 3)")
def jn10_created_path(s: SparkSession, d: str) -> DataFrame:
    return D.with_paths(D.created(folders(s, d), "AFRICA/NEW/DEEP", 1000)).select("path", "depth")


@query("SELECT * FROM (VALUES ('down', 'into itself'), ('none', 'unknown folder'), ('taken', 'name taken')) t(move, error)")
def hie02_checked_moves(s: SparkSession, d: str) -> DataFrame:
    tree = D.with_paths(folders(s, d))
    moves = {"down": ("AFRICA", "AFRICA/X"), "none": ("NOWHERE", "X"), "taken": ("AFRICA", "ASIA"), "good": ("AFRICA", "ASIA/AFRICA")}
    out = [D.checked_move(tree, *m).select(F.lit(k).alias("move"), "error") for k, m in moves.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT case_id FROM v_case WHERE folder_path NOT IN ('A/B', 'A/B/C')", "case")
def hie03_subtree_cases(s: SparkSession, d: str) -> DataFrame:
    tree = D.with_paths(folders(s, d))
    return D.deleted("A/B", tree, view(s, d, "document"), view(s, d, "case"))[2].select("case_id")


@query(FOLDERS + "SELECT path FROM tree WHERE depth = 2 AND starts_with(path, 'ASIA/')")
def hie04_below(s: SparkSession, d: str) -> DataFrame:
    return D.below(D.with_paths(folders(s, d)), 2).select("path")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS ts, user_id % 2 <> 0 AS flag, '***' AS key, event_type AS model FROM events""")
def prj01_records(s: SparkSession, d: str) -> DataFrame:
    config = F.create_map(F.lit("api_key"), F.lit("secret"), F.lit("model"), F.col("event_type"))
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", "ts", (F.col("user_id") % 2).alias("flag"), config.alias("config"))
    return records.record(rows, times=("ts",), flags=("flag",), secrets=("config",)).select("event_id", "ts", "flag", F.col("config")["api_key"].alias("key"), F.col("config")["model"].alias("model"))


@query("SELECT event_id, 'model=' || event_type AS config FROM events")
def prj02_without_secrets(s: SparkSession, d: str) -> DataFrame:
    config = F.create_map(F.lit("api_key"), F.lit("secret"), F.lit("model"), F.col("event_type"))
    kept = F.map_entries(records.without_secrets(config))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("config"))


@query("""SELECT case_id, CASE difficulty WHEN 'L1' THEN '简单' WHEN 'L2' THEN '中等' ELSE '—' END AS difficulty, CASE c.review_status WHEN 'quality_verified' THEN '已通过' ELSE '待审核' END AS review,
CASE eiu_type WHEN 'rule' THEN '规则' WHEN 'definition' THEN '定义' WHEN 'process' THEN '流程' ELSE '规则' END AS type, CASE content_priority WHEN 'P1' THEN '必须覆盖' ELSE '建议覆盖' END AS priority,
CASE WHEN eiu_type IN ('rule', 'definition') THEN eiu_type ELSE 'rule' END AS question_type FROM v_case c JOIN v_eiu e USING (eiu_id)""", "case", "eiu")
def prj05_labels(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "case").withColumnRenamed("review_status", "status").join(view(s, d, "eiu"), "eiu_id")
    kind = F.when(F.col("eiu_type").isin("rule", "definition"), F.col("eiu_type")).otherwise(F.lit("other"))
    return rows.select(
        "case_id", records.difficulty_label(F.col("difficulty")).alias("difficulty"), records.review_label(F.col("status")).alias("review"), records.type_label(F.col("eiu_type")).alias("type"),
        records.priority_label(F.col("content_priority")).alias("priority"), records.question_type(kind).alias("question_type"),
    )


EVIDENCE = "array(named_struct('block_text', IF(block_id % 3 = 0, '', block_text), 'content', 'c', 'text', 't', 'section_path', IF(block_id % 5 = 0, '', section_path), 'source', 'src'), named_struct('block_text', CAST(NULL AS STRING), 'content', '', 'text', IF(block_id % 2 = 0, '', 'last'), 'section_path', '', 'source', ''))"


@query("""SELECT block_id, CASE WHEN block_id % 3 = 0 THEN 'c' ELSE block_text END || CASE WHEN block_id % 2 = 0 THEN '' ELSE '；last' END AS text, CASE WHEN block_id % 5 = 0 THEN '（无章节）' ELSE section_path END AS sections,
CASE WHEN block_id % 5 = 0 THEN 'src' ELSE section_path END AS source, CASE WHEN block_id % 7 = 0 THEN 'own' WHEN block_id % 5 = 0 THEN '（无章节）' ELSE section_path END AS section, '—' AS none FROM v_block""", "block")
def prj06_evidence(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "block").withColumn("e", F.expr(EVIDENCE))
    own = F.when(F.col("block_id") % 7 == 0, "own").otherwise("")
    return rows.select(
        "block_id", records.evidence_text(F.col("e")).alias("text"), records.evidence_sections(F.col("e")).alias("sections"), records.evidence_source(F.col("e")).alias("source"),
        records.statement_section(own, F.col("e")).alias("section"), records.evidence_text(F.slice("e", 1, 0)).alias("none"),
    )


def patches(s: SparkSession, d: str) -> DataFrame:
    """Edits of statements, some of which must be refused."""
    k = F.col("eiu_id") % 100
    none = F.lit(None).cast("string")
    constraints = F.when(k == 4, F.create_map(F.lit("subject"), F.repeat(F.lit("x"), 17_000))).when(k == 5, F.create_map(F.lit("subject"), F.lit("bank")))
    return view(s, d, "eiu").where(k < 10).select(
        "eiu_id", F.when(k == 0, F.repeat(F.lit("s"), 201)).when(k == 1, "new").alias("statement"), F.when(k == 2, "odd").when(k == 3, "metric").alias("eiu_type"),
        F.when(k == 6, "P9").when(k == 7, "P0").otherwise(none).alias("content_priority"), F.when(k == 8, F.lit(True)).when(k == 9, F.lit(False)).alias("is_questionable"),
        F.when(k == 1, "why").otherwise(none).alias("exclusion_reason"), constraints.alias("constraints"), F.when(k == 3, 1.5).alias("extraction_confidence"),
    )


@query("""SELECT eiu_id, CASE eiu_id % 100 WHEN 0 THEN 'statement' WHEN 2 THEN 'eiu_type' WHEN 3 THEN 'extraction_confidence' WHEN 4 THEN 'constraints' WHEN 6 THEN 'content_priority' ELSE '' END AS problems FROM v_eiu WHERE eiu_id % 100 < 10""", "eiu")
def arr05_requests(s: SparkSession, d: str) -> DataFrame:
    return patches(s, d).select("eiu_id", F.array_join(requests.statement_edit(), ",").alias("problems"))


@query("""SELECT eiu_id, CASE eiu_id % 100 WHEN 1 THEN 'new' ELSE statement END AS statement, CASE eiu_id % 100 WHEN 7 THEN 'P0' ELSE content_priority END AS content_priority, CASE eiu_id % 100 WHEN 7 THEN 5 ELSE weight END AS weight,
CASE WHEN eiu_id % 100 = 8 THEN true WHEN eiu_id % 100 = 9 AND exclusion_reason IS NOT NULL THEN false ELSE is_questionable END AS is_questionable, CASE eiu_id % 100 WHEN 1 THEN 'why' WHEN 8 THEN NULL ELSE exclusion_reason END AS exclusion_reason FROM v_eiu""", "eiu")
def wfl16_edits(s: SparkSession, d: str) -> DataFrame:
    eiu = view(s, d, "eiu").withColumns({"constraints": F.lit(None).cast("map<string,string>"), "extraction_confidence": F.lit(None).cast("double")})
    return W.edited(eiu, patches(s, d))[0].select("eiu_id", "statement", "content_priority", "weight", "is_questionable", "exclusion_reason")


@query("""SELECT 'refused' AS kind, eiu_id, CASE eiu_id % 100 WHEN 0 THEN 'statement' WHEN 2 THEN 'eiu_type' WHEN 3 THEN 'extraction_confidence' WHEN 4 THEN 'constraints' WHEN 6 THEN 'content_priority' ELSE 'exclusion_reason' END AS what FROM v_eiu
WHERE eiu_id % 100 IN (0, 2, 3, 4, 6) OR (eiu_id % 100 = 9 AND exclusion_reason IS NULL) UNION ALL
SELECT 'audit', eiu_id, CASE eiu_id % 100 WHEN 1 THEN 'exclusion_reason,statement' WHEN 5 THEN 'constraints' WHEN 7 THEN 'content_priority,weight' WHEN 8 THEN 'exclusion_reason,is_questionable' ELSE 'is_questionable' END FROM v_eiu
WHERE eiu_id % 100 IN (1, 5, 7, 8) OR (eiu_id % 100 = 9 AND exclusion_reason IS NOT NULL)""", "eiu")
def wfl16_audit(s: SparkSession, d: str) -> DataFrame:
    eiu = view(s, d, "eiu").withColumns({"constraints": F.lit(None).cast("map<string,string>"), "extraction_confidence": F.lit(None).cast("double")})
    _, log, refused = W.edited(eiu, patches(s, d))
    done = log.select(F.lit("audit").alias("kind"), F.col("target_id").cast("long").alias("eiu_id"), F.array_join("fields", ",").alias("what"))
    return refused.select(F.lit("refused").alias("kind"), "eiu_id", F.array_join("problems", ",").alias("what")).unionByName(done)


@query("SELECT 'delete' AS operation, CAST(eiu_id AS STRING) AS target_id, 'review_status' AS fields FROM v_eiu WHERE eiu_id % 10 = 1", "eiu")
def wfl16_deleted(s: SparkSession, d: str) -> DataFrame:
    eiu = view(s, d, "eiu")
    keys = eiu.select("eiu_id").where("eiu_id % 10 = 1").unionByName(s.createDataFrame([(-5,)], "eiu_id long"))
    return W.deleted(eiu, keys)[1].select("operation", "target_id", F.array_join("fields", ",").alias("fields"))


def sound_upload(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "upload").where("trim(q) <> '' AND trim(a) <> ''")


@query(f"""SELECT CAST(9 AS BIGINT) AS set_id, 'mine' AS name, 'single' AS template_type, 'quality_checked' AS review_status, CAST(count(*) AS BIGINT) AS total_cases, 1.0 :: DOUBLE AS completeness,
round((count(*) - count(DISTINCT regexp_replace(lower(q), '{SPACE}', '', 'g'))) / CAST(count(*) AS DOUBLE), 4) AS duplicates FROM v_upload WHERE trim(q) <> '' AND trim(a) <> ''""", "upload")
def wfl11_upload(s: SparkSession, d: str) -> DataFrame:
    made = U.imported_upload(sound_upload(s, d).drop("set_id"), 9, "mine").sets
    quality = F.col("quality_snapshot")
    return made.select("set_id", "name", "template_type", "review_status", "total_cases", quality["data_completeness_rate"].alias("completeness"), quality["duplicate_question_ratio"].alias("duplicates"))


@query("SELECT case_id, CAST(9 AS BIGINT) AS set_id, q, a, coalesce(length(evidence), 0) = 0 AS no_evidence, 'quality_checked' AS review_status FROM v_upload WHERE trim(q) <> '' AND trim(a) <> ''", "upload")
def snk17_upload_cases(s: SparkSession, d: str) -> DataFrame:
    return U.imported_upload(sound_upload(s, d).drop("set_id"), 9, "mine").cases.select("case_id", "set_id", "q", "a", "no_evidence", "review_status")


@query("""SELECT case_id, error FROM (SELECT case_id, unnest(CASE WHEN trim(q) = '' AND trim(a) = '' THEN ['missing q', 'missing a'] WHEN trim(q) = '' THEN ['missing q'] WHEN trim(a) = '' THEN ['missing a'] ELSE [] END) AS error FROM v_upload)
ORDER BY case_id, error DESC LIMIT 20""", "upload")
def wfl11_refused(s: SparkSession, d: str) -> DataFrame:
    """A set with faulty cases isn't imported; the first 20 errors are the report."""
    made = U.imported_upload(view(s, d, "upload").drop("set_id"), 9, "mine")
    return made.errors.select("case_id", "error").join(made.sets.select(F.lit(True).alias("_made")), F.lit(True), "left_anti")


@query("SELECT set_id, case_id FROM v_upload WHERE set_id <> 3", "upload")
def snk17_deleted_set(s: SparkSession, d: str) -> DataFrame:
    return U.without_set(sets(s, d), view(s, d, "upload"), 3)[1].select("set_id", "case_id")


@query("SELECT case_id, CAST(5 AS BIGINT) AS set_id, q, a, 'quality_checked' AS review_status FROM v_public", "public")
def snk18_public_cases(s: SparkSession, d: str) -> DataFrame:
    sent = view(s, d, "public").drop("set_id").withColumns({"review_status": F.lit("published"), "evidence": F.lit(None).cast("string")})
    return U.imported_public(sent, 5, "open", dimensions=["even"]).cases.select("case_id", "set_id", "q", "a", "review_status")


_ITEMS = """WITH i AS (SELECT CAST(s_suppkey AS INTEGER) AS item_pos, CASE s_suppkey % 4 WHEN 0 THEN 'doc_generated' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'public' ELSE CASE WHEN s_suppkey % 8 = 3 THEN 'doc_generated' ELSE 'mail' END END AS source, s_nationkey % 12 AS ref FROM supplier),
e AS (SELECT item_pos, CASE WHEN source = 'mail' THEN 'unknown source' WHEN source = 'doc_generated' AND n_nationkey IS NULL THEN 'version not found' WHEN source = 'doc_generated' AND n_regionkey % 2 = 0 THEN 'version not frozen'
WHEN source = 'uploaded' AND ref NOT IN (SELECT conv_id % 7 FROM conversations) THEN 'uploaded set not found' WHEN source = 'public' AND ref NOT IN (SELECT item_id % 3 FROM benchmark) THEN 'public set not found' END AS error
FROM i LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 4) ON n_nationkey = ref) """


def composition_items(s: SparkSession, d: str) -> DataFrame:
    """Items of a composition: one of each supplier, with references some of which are to nothing."""
    k, ref = F.col("s_suppkey"), F.col("s_nationkey") % 12
    source = F.when(k % 4 == 0, "doc_generated").when(k % 4 == 1, "uploaded").when(k % 4 == 2, "public").when(k % 8 == 3, "doc_generated").otherwise("mail")
    doc = source == "doc_generated"
    return s.read.parquet(f"{d}/supplier.parquet").select(
        k.cast("int").alias("item_pos"), source.alias("source"), F.when(doc, ref).cast("long").alias("version_id"), F.when(~doc, ref).cast("long").alias("set_id"), F.lit(None).cast("string").alias("dimension")
    )


def known_sources(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions, uploaded sets and public sets of the tables."""
    versions = s.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 5 <> 4").select(F.col("n_nationkey").cast("long").alias("version_id"), F.when(F.col("n_regionkey") % 2 == 0, "draft").otherwise("frozen").alias("status"))
    return versions, view(s, d, "upload").select("set_id").distinct(), view(s, d, "public").select("set_id").distinct()


@query(_ITEMS + "SELECT item_pos, error FROM e WHERE error IS NOT NULL")
def jn13_item_errors(s: SparkSession, d: str) -> DataFrame:
    return U.composition_errors(composition_items(s, d), *known_sources(s, d))


@query(_ITEMS + "SELECT 'composition.create' AS operation, '4' AS target_id, 'me' AS actor, CAST(count(*) AS BIGINT) AS n_items, CAST(sum(item_pos) AS BIGINT) AS positions FROM e WHERE error IS NULL")
def wfl12_composition(s: SparkSession, d: str) -> DataFrame:
    """The items without an error make a composition."""
    items, known = composition_items(s, d), known_sources(s, d)
    sound = items.join(U.composition_errors(items, *known).select("item_pos"), "item_pos", "left_anti")
    made = U.created(sound, 4, "mix", *known, created_by="me")
    return made.audit.join(made.items.agg(F.count(F.lit(1)).alias("n_items"), F.sum("item_pos").alias("positions"))).select("operation", "target_id", "actor", "n_items", "positions")


@query(_ITEMS + f"SELECT item_pos, error, CAST(0 AS BIGINT) AS n_items FROM e WHERE error IS NOT NULL ORDER BY item_pos LIMIT {S.MAX_ERRORS}")
def wfl12_refused(s: SparkSession, d: str) -> DataFrame:
    """All items together are refused, with the first errors, and nothing is made."""
    made = U.created(composition_items(s, d), 4, "mix", *known_sources(s, d))
    return made.errors.join(made.items.agg(F.count(F.lit(1)).alias("n_items")))


def covered_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Statements that all have a publishable case, and blocks that all have such a statement."""
    cases = view(s, d, "case")
    eiu = view(s, d, "eiu").join(V.covered_ids(cases), "eiu_id", "left_semi").where("review_status <> 'blocked'")
    return eiu, view(s, d, "block").join(eiu.select("block_id"), "block_id", "left_semi"), view(s, d, "document"), cases


_KEY = "lower(regexp_replace(question, '[ ?!]', '', 'g'))"


@query(f"""SELECT CAST(25 AS BIGINT) AS version_id, 'v1.0.25' AS version_number, 'frozen' AS status, CAST(count(*) AS BIGINT) AS case_count, max(case_uid) AS last_uid FROM (
SELECT printf('case_%04d_%06d', 25, case_id) AS case_uid, row_number() OVER (PARTITION BY {_KEY} ORDER BY case_id DESC) AS r FROM v_case WHERE review_status = 'quality_verified') WHERE r = 1""", "case")
def wfl09_release(s: SparkSession, d: str) -> DataFrame:
    versions = view(s, d, "document").select(F.col("document_id").alias("version_id"), F.format_string("v1.0.%d", "document_id").alias("version_number"))
    made = R.release(*covered_tables(s, d), versions, created_by="me")
    return made.version.join(made.cases.agg(F.max("case_uid").alias("last_uid"))).select("version_id", "version_number", "status", "case_count", "last_uid")


@query("SELECT 'weighted_coverage,p0_coverage,reconciliation' AS refused, CAST(0 AS BIGINT) AS versions, CAST(1 AS BIGINT) AS reports")
def wfl09_refused(s: SparkSession, d: str) -> DataFrame:
    """Nothing is frozen where the gate fails, though the report is there."""
    versions = s.createDataFrame([], "version_id long, version_number string")
    eiu = view(s, d, "eiu")
    made = R.release(eiu.where("block_id % 2 = 0"), view(s, d, "block"), view(s, d, "document"), view(s, d, "case"), versions)
    return made.refused.join(made.version.agg(F.count(F.lit(1)).alias("versions"))).join(made.report.agg(F.count(F.lit(1)).alias("reports")))


@query(f"""SELECT retired, CAST(count(*) AS BIGINT) AS n FROM (SELECT true AS retired FROM v_case WHERE case_id % 1000 = 1 UNION ALL SELECT false FROM (
SELECT row_number() OVER (PARTITION BY {_KEY} ORDER BY case_id DESC) AS r FROM v_case WHERE review_status = 'quality_verified') WHERE r = 1) GROUP BY retired""", "case")
def wfl15_rebuilt(s: SparkSession, d: str) -> DataFrame:
    cases = view(s, d, "case")
    old = C.freeze(cases.where("case_id % 1000 = 1").withColumns({"review_status": F.lit("published"), "question": F.col("case_id").cast("string")}), 3)
    return L.row_count(R.rebuilt(old, cases, 3), "retired")


@query("""SELECT CASE WHEN e.eiu_id % 2 = 0 THEN '泛化问题' ELSE '基础问题' END AS purpose, p.path, p.depth, CAST(sum(CASE WHEN c.folder_path = p.path THEN 1 ELSE 0 END) AS BIGINT) AS files FROM v_case c JOIN v_eiu e USING (eiu_id),
LATERAL (SELECT * FROM (VALUES ('', 0), ('A', 1), ('A/B', 2), ('A/B/C', 3)) t(path, depth) WHERE c.folder_path = path OR path = '' OR starts_with(c.folder_path, path || '/')) p
WHERE c.folder_path = 'A' OR starts_with(c.folder_path, 'A/') GROUP BY 1, 2, 3""", "case", "eiu")
def snk04_folder_tree(s: SparkSession, d: str) -> DataFrame:
    cases = view(s, d, "case").withColumn("purpose", F.when(F.col("eiu_id") % 2 == 0, "gen").otherwise("basic"))
    return writers.folder_tree(cases, "A").select("purpose", "path", "depth", F.size("files").cast("long").alias("files"))


@query("""SELECT case_id, '## ' || CAST(case_id AS STRING) || ' · ' || question || chr(10) || '- 题型: rule / 难度: ' || coalesce(difficulty, 'None') || ' / 优先级: P1 / 状态: ' || review_status || chr(10) || '- 标准答案: ' || gold_answer || chr(10)
|| '- 必须命中要点:' || chr(10) || '  - p' || chr(10) || '  - q' || chr(10) AS value FROM v_case WHERE document_id = 3 AND review_status <> 'retired'""", "case")
def snk05_markdown(s: SparkSession, d: str) -> DataFrame:
    cases = C.filter_cases(view(s, d, "case"), document_id=3)
    return writers.markdown(cases.withColumns({"question_type": F.lit("rule"), "content_priority": F.lit("P1"), "must_have_points": F.array(F.lit("p"), F.lit("q"))}))


@query("""SELECT case_id, CAST(to_json({'case_id': case_id, 'question': question, 'difficulty': difficulty, 'document_id': document_id, 'review_status': review_status}) AS STRING) AS value FROM v_case WHERE document_id = 3 AND difficulty = 'L1' AND review_status = 'candidate'""", "case")
def snk05_json(s: SparkSession, d: str) -> DataFrame:
    cases = view(s, d, "case").select("case_id", "question", "difficulty", "document_id", "review_status")
    return writers.case_objects(cases, document_id=3, difficulty="L1", status="candidate")


@query("""SELECT 1 AS part, row_number() OVER (ORDER BY check_type) AS position, '| ' || check_type || ' | ' || CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS STRING) || ' | ' || CAST(sum(CASE WHEN passed THEN 0 ELSE 1 END) AS STRING) || ' |' AS value FROM v_checks GROUP BY check_type
UNION ALL SELECT 2, case_id, '- case ' || CAST(case_id AS STRING) || '：' || string_agg(check_type, ', ' ORDER BY check_type) || chr(10) || '  - ' || string_agg(reason, ';' ORDER BY check_type) FROM v_checks WHERE NOT passed GROUP BY case_id
UNION ALL SELECT 0, 0, '# 质量校验报告' || chr(10) || chr(10) || '- 参与校验样本：' || CAST(count(*) AS STRING) || chr(10) || '- 通过：' || CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS STRING) || ' / 失败：' || CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS STRING) || chr(10)
FROM (SELECT case_id, bool_and(passed) AS ok FROM v_checks GROUP BY case_id)""", "checks")
def snk06_quality_report(s: SparkSession, d: str) -> DataFrame:
    cases = view(s, d, "text").select(F.col("document_id").alias("case_id"), F.lit("candidate").alias("review_status"))
    return writers.quality_report(cases, checks(s, d))


@query("""SELECT 'case_0007_' || CASE WHEN case_id < 100000 THEN lpad(CAST(case_id AS STRING), 6, '0') ELSE CAST(case_id AS STRING) END || ',"a ""' || CAST(case_id AS STRING) || '"", b",' || coalesce(difficulty, '') AS value FROM v_case
UNION ALL SELECT chr(65279) || 'case_id,question,difficulty'""", "case")
def snk03_csv_lines(s: SparkSession, d: str) -> DataFrame:
    """All lines, and the header once, which each part file has."""
    uid = F.format_string("case_%04d_%06d", F.lit(7), "case_id")
    rows = view(s, d, "case").select(uid.alias("case_id"), F.concat(F.lit('a "'), F.col("case_id").cast("string"), F.lit('", b')).alias("question"), "difficulty")
    return writers.csv_lines(rows).distinct()


@query(f"""SELECT block_id, {truncated_sql(trim_sql("block_text"))} AS statement, CASE WHEN block_id % 3 = 0 THEN 'P2' ELSE 'P1' END AS content_priority, block_id % 4 <> 0 AS is_questionable,
CASE WHEN block_id % 4 = 0 THEN '未说明排除原因' END AS exclusion_reason, CASE WHEN block_id % 7 = 0 THEN 1.0 ELSE 0.8 END :: DOUBLE AS confidence, 'bank' AS subject FROM v_block WHERE block_id % 5 <> 0""", "block")
def arr02_normalised(s: SparkSession, d: str) -> DataFrame:
    k = F.col("block_id")
    item = F.struct(
        F.concat(F.lit("  "), F.col("block_text")).alias("statement"), F.when(k % 5 == 0, "odd").otherwise("rule").alias("eiu_type"), F.when(k % 3 == 0, "P7").otherwise("P1").alias("content_priority"),
        (k % 4 != 0).alias("is_questionable"), F.when(k % 7 == 0, 1.7).alias("extraction_confidence"), F.create_map(F.lit("subject"), F.lit("bank"), F.lit("other"), F.lit("x")).alias("constraints"),
    )
    replies = view(s, d, "block").select("block_id", F.to_json(F.struct(F.array(item).alias("items"))).alias("reply"))
    return X.from_replies(replies, "m").select("block_id", "statement", "content_priority", "is_questionable", "exclusion_reason", F.col("extraction_confidence").alias("confidence"), F.col("constraints.subject").alias("subject"))


def lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for an encoder."""
    return [[float(len(t)), 100.0] for t in texts]


@query("SELECT doc_id, round((length(text) + 2) / sqrt((length(text) + 2) * (length(text) + 2) + 10000.0), 4) AS first, round(100 / sqrt((length(text) + 2) * (length(text) + 2) + 10000.0), 4) AS second FROM documents")
def mth03_encoded(s: SparkSession, d: str) -> DataFrame:
    rows = T.encoded(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), lengths, prefix="q:")
    return rows.select("doc_id", *[F.round(F.col("embedding")[i].cast("double"), 4).alias(n) for i, n in enumerate(("first", "second"))])


@query("SELECT item_id FROM v_vector WHERE item_id % 10 <> 3", "vector")
def top03_removed(s: SparkSession, d: str) -> DataFrame:
    vectors = view(s, d, "vector").withColumn("document_id", F.col("item_id") % 10)
    return T.without_documents(vectors, s.createDataFrame([(3,)], "document_id long")).select("item_id")


@query("SELECT 'kept' AS kind, CAST(count(*) AS BIGINT) AS n FROM v_case WHERE document_id <> 4 UNION ALL SELECT 'asked', CAST(count(*) AS BIGINT) FROM v_eiu JOIN v_block USING (block_id) WHERE is_questionable AND document_id = 4", "case", "eiu", "block")
def wfl06_rebuild(s: SparkSession, d: str) -> DataFrame:
    eiu = view(s, d, "eiu").join(view(s, d, "block").select("block_id", "document_id"), "block_id")
    asked, kept = G.wanted(eiu, view(s, d, "case"), "rebuild", 4)
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("kind"), "n").unionByName(asked.agg(F.count(F.lit(1)).alias("n")).select(F.lit("asked").alias("kind"), "n"))


@query("""SELECT doc_id AS case_id, CASE WHEN quality = 1 THEN 'candidate' ELSE 'retired' END AS review_status FROM labels""")
def wfl07_passing(s: SparkSession, d: str) -> DataFrame:
    made = checks(s, d).select("case_id", F.lit("candidate").alias("review_status")).distinct()
    return G.passing(made, checks(s, d)).select("case_id", "review_status")


@query("""SELECT eiu_id, 'Write one question, with its answer, that the statement answers under the angle, as a JSON array of objects with question and gold_answer.' || chr(10) || 'statement: ' || statement
|| CASE WHEN exclusion_reason IS NULL THEN '' ELSE chr(10) || 'note: ' || exclusion_reason END AS prompt FROM v_eiu""", "eiu")
def ext03_prompts(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "eiu").select("eiu_id", G.prompt("question", statement=F.col("statement"), note=F.col("exclusion_reason")).alias("prompt"))
