"""Registered queries of search: neighbours of many vectors, terms, candidates across segments; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.operators import neighbours as N
from assaymill.operators import terms as I
from assaymill.operators import vectors as T
from assaymill.plans.queries import query
from assaymill.plans.session import checkpoints, temporary
from assaymill.plans.views import view
from assaymill.sources.vector_index import VectorIndex

TOKENS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda x: lower(x))"
PRODUCTS = """SELECT a.item_id AS query_id, b.item_id, a.grp, b.item_id % 3 = a.item_id % 3 AS together, round(list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 9) AS score
FROM v_vector a JOIN v_vector b ON a.item_id <> b.item_id AND a.grp = b.grp"""


@query(f"""SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ({PRODUCTS}) WHERE NOT together) WHERE rank <= 5""", "vector")
def mh_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Five neighbours of every vector, of its own label and of another document."""
    rows = view(s, d, "vector").withColumn("document_id", F.col("item_id") % 3)
    return N.nearest(rows.withColumnRenamed("item_id", "query_id"), rows, 5, same=["grp"], other=["document_id"]).withColumn("score", F.round("score", 9))


def texts(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "text").select(F.col("document_id").alias("block_id"), "text")


def questions(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def index(s: SparkSession, d: str) -> I.TermIndex:
    return I.build(texts(s, d), temporary(s, "terms"))


INDEX = f"""WITH w AS (SELECT doc_id AS block_id, {TOKENS} AS w FROM documents), l AS (SELECT block_id, len(w) AS length FROM w), t AS (SELECT block_id, unnest(w) AS term, unnest(range(len(w))) AS position FROM w),
p AS (SELECT term, block_id, count(*) AS n FROM t GROUP BY term, block_id), f AS (SELECT term, count(*) AS blocks, sum(n) AS occurrences FROM p GROUP BY term),
u AS (SELECT count(*) AS blocks, sum(length) AS words FROM l), q AS (SELECT item_id AS query_id, {TOKENS} AS w FROM benchmark), a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(w) AS term FROM q) GROUP BY query_id, term),
b AS (SELECT query_id, block_id, round(sum(times * ln(1 + (u.blocks - f.blocks + 0.5) / (f.blocks + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length * u.blocks / u.words))), 6) AS score, count(*) AS overlap
FROM a JOIN f USING (term) JOIN p USING (term) JOIN l USING (block_id), u GROUP BY query_id, block_id) """


@query(INDEX + "SELECT term, CAST(blocks AS BIGINT) AS blocks, CAST(occurrences AS BIGINT) AS occurrences FROM f")
def trm_terms(s: SparkSession, d: str) -> DataFrame:
    return index(s, d).terms.select("term", "blocks", "occurrences")


@query(INDEX + "SELECT query_id, block_id, score, CAST(overlap AS BIGINT) AS overlap FROM b")
def trm_bm25(s: SparkSession, d: str) -> DataFrame:
    """All questions of the benchmark at once, every block that shares a word with one."""
    return I.bm25(index(s, d), questions(s, d)).withColumn("score", F.round("score", 6))


@query(INDEX + r"""SELECT query_id, block_id, CAST(i AS INTEGER) AS position FROM (SELECT query_id, block_id, q.w AS asked, w.w AS w, unnest(range(len(w.w) - 3)) AS i FROM q JOIN w ON len(w.w) > 3 AND list_contains(w.w, q.w[3])) WHERE w[i + 1:i + 4] = asked[3:6]""")
def trm_phrases(s: SparkSession, d: str) -> DataFrame:
    """The third to sixth word of each question, wherever they stand together."""
    words = I.tokens(F.coalesce("text", F.lit("")))
    return I.phrases(index(s, d), questions(s, d).select("query_id", F.array_join(F.slice(words, 3, 4), " ").alias("text")))


@query(INDEX + """, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, block_id) AS rank FROM b) WHERE rank <= 3),
h AS (SELECT query_id, block_id, term, min(position) AS position FROM k JOIN a USING (query_id) JOIN t USING (block_id, term) GROUP BY query_id, block_id, term),
g AS (SELECT query_id, block_id, min(position) AS position, string_agg(term, ' ' ORDER BY position) AS found FROM h GROUP BY query_id, block_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, block_id, CAST(position AS INTEGER) AS position, found, array_to_string(w[greatest(position - 8, 0) + 1:position + 9], ' ') AS excerpt, source FROM k JOIN g USING (query_id, block_id) JOIN w USING (block_id) JOIN documents ON doc_id = block_id""")
def trm_evidence(s: SparkSession, d: str) -> DataFrame:
    """Three pieces of evidence for each question, in order, with their place."""
    blocks = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("block_id"), "text", "source")
    return I.evidence(index(s, d), blocks, questions(s, d), 3).select("query_id", "rank", "block_id", "position", "found", "excerpt", "source")


_KIND = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(S.STATEMENT_TYPES)) + " END"
_PAIRS = ", ".join(f"'{'+'.join(sorted(p))}'" for p in S.COMPLEMENTS)


@query(f"""WITH s AS (SELECT doc_id AS id, text, CAST(embedding AS DOUBLE[]) AS v, {_KIND} AS kind, label, doc_id % 3 AS doc FROM documents JOIN embeddings ON doc_id = vec_id),
x AS (SELECT a.id AS q, b.id AS i, round(list_inner_product(a.v, b.v), 12) AS score FROM s a JOIN s b ON a.id <> b.id AND a.label = b.label AND a.doc <> b.doc),
near AS (SELECT q, i FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS r FROM x) WHERE r <= 5),
t AS (SELECT DISTINCT id, unnest({TOKENS}) AS term FROM s), f AS (SELECT term, count(*) AS n FROM t GROUP BY term HAVING count(*) BETWEEN 2 AND 20), u AS (SELECT count(*) AS n FROM s),
c AS (SELECT a.id AS q, b.id AS i, sum(CAST(round(ln(1 + (u.n - f.n + 0.5) / (f.n + 0.5)) * 1e9) AS BIGINT)) / 1e9 AS weight FROM t a JOIN t b USING (term) JOIN f USING (term) JOIN s y ON y.id = a.id JOIN s z ON z.id = b.id, u WHERE a.id <> b.id AND y.label = z.label AND y.doc <> z.doc GROUP BY 1, 2),
words AS (SELECT q, i, weight FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY weight DESC, i) AS r FROM c) WHERE r <= 5),
m AS (SELECT least(q, i) AS item_a, greatest(q, i) AS item_b, bool_or(v) AS by_vector, bool_or(NOT v) AS by_terms, max(weight) AS weight FROM (SELECT q, i, true AS v, NULL AS weight FROM near UNION ALL SELECT q, i, false, weight FROM words) GROUP BY 1, 2)
SELECT item_a, item_b, by_vector, by_terms, round(list_inner_product(y.v, z.v), 9) AS score, weight, CASE WHEN list_inner_product(y.v, z.v) >= 0.92 OR y.text = z.text AND y.text <> '' THEN 'duplicate'
WHEN least(y.kind, z.kind) || '+' || greatest(y.kind, z.kind) IN ({_PAIRS}) THEN 'complementary' ELSE 'related' END AS relation FROM m JOIN s y ON y.id = item_a JOIN s z ON z.id = item_b""")
def mh_candidates(s: SparkSession, d: str) -> DataFrame:
    """Documents that have a vector, as statements: candidates of one label and of different documents."""
    vectors = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").join(vectors, "doc_id")
    kind = F.element_at(F.array(*map(F.lit, S.STATEMENT_TYPES)), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = rows.select(F.col("doc_id").alias("item_id"), "vector", "text", kind.alias("kind"), "label", (F.col("doc_id") % 3).alias("doc"))
    terms = I.build(rows, temporary(s, "terms"), key="item_id")
    return N.candidates(rows, terms, 5, same=["label"], other=["doc"]).withColumn("score", F.round("score", 9))


@query("""SELECT item_id, CAST(CASE WHEN item_id % 7 = 0 THEN -vector[1] ELSE vector[1] END AS DOUBLE) AS first FROM v_vector WHERE (item_id % 10 <> 3 OR item_id % 3 = 2 OR item_id % 7 = 0) AND item_id % 11 <> 5""", "vector")
def top08_index(s: SparkSession, d: str) -> DataFrame:
    """What is in an index after batches, a removed document, replaced vectors, a compaction and removed ids."""
    rows = view(s, d, "vector").withColumn("document_id", F.col("item_id") % 10)
    held = VectorIndex(s, temporary(s, "index"))
    held.add(rows.where("item_id % 3 < 2"))
    held.remove(documents=s.range(3, 4).withColumnRenamed("id", "document_id"))
    held.add(rows.where("item_id % 3 = 2"))
    held.add(rows.where("item_id % 7 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))
    held.compact()
    held.remove(ids=rows.where("item_id % 11 = 5"))
    return held.live().select("item_id", F.col("vector")[0].cast("double").alias("first"))


def apart(asked: list[str], found: list[str]) -> list[float]:
    """A stand-in for a model of pairs: near lengths are alike."""
    return [-float(abs(len(q) - len(t))) for q, t in zip(asked, found, strict=True)]


@query(INDEX + """, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, block_id) AS r FROM b) WHERE r <= 10)
SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, block_id AS item_id, CAST(-abs(length(i.text) - length(d.text)) AS DOUBLE) AS score,
row_number() OVER (PARTITION BY query_id ORDER BY -abs(length(i.text) - length(d.text)) DESC, block_id) AS rank FROM k JOIN benchmark i ON i.item_id = query_id JOIN documents d ON d.doc_id = block_id) WHERE rank <= 3""")
def top06_reranked(s: SparkSession, d: str) -> DataFrame:
    """Three of the ten texts that the index finds for each question: both cuts are the operators'."""
    asked = questions(s, d)
    checkpoints(s)
    found = I.best_blocks(index(s, d), asked, 10).select("query_id", F.col("block_id").alias("item_id")).checkpoint()  # ten rows a question
    pairs = texts(s, d).withColumnRenamed("block_id", "item_id").join(I.small(found), "item_id").join(I.small(asked.withColumnRenamed("text", "question")), "query_id")
    return T.reranked(pairs, apart, 3).select("query_id", "item_id", "score", "rank")
