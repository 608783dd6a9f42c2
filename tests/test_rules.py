"""Text rules, parsing folds, sources and workflow operators on hand-made rows."""

import hashlib
import re
import zipfile
from importlib.util import find_spec

import pytest
from pyspark.sql import functions as F

from assaymill.functions import scoring, text
from assaymill.operators import adapters, cases, coverage, evalsets, extraction, folders, generation, ingest, lookups, parsing, quality, vectors
from assaymill.sources import readers, writers


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


@pytest.mark.parametrize(("sentence", "kind", "priority"), [
    ("本办法所称小微企业是指符合标准的企业", "definition", "P1"), ("贷款额度不得超过70%", "threshold", "P0"), ("原则上由支行负责审核", "rule", "P1"), ("不得超过核定的额度", "prohibition", "P0"),
    ("特殊情况可放宽至90天以上", "exception", "P0"), ("本办法自2024年1月1日起施行", "date", "P1"), ("业务流程分为四个阶段", "process", "P1"), ("年末余额达到500万元", "metric", "P2"),
    ("风险率=逾期金额", "formula", "P1"), ("本条款较2020年度修订", "change", "P1"), ("这是一段普通的说明文字", "rule", "P2"), ("太短了", None, None), ("四个字吗", None, None),
])
def test_classifier(spark, sentence, kind, priority):
    (got,) = values(spark, text.classified, sentence)
    assert (got and (got.eiu_type, got.content_priority)) == (kind and (kind, priority))


def test_keys(spark):
    assert values(spark, text.question_key, "利率 是７0％吗？", "Is it 70%?", None, "　a b") == ["利率是７0%吗", "isit70%", "", "ab"]
    assert values(spark, text.answer_key, " ７０％ ，是 ", None, "1,000 Ａ") == ["70%,是", "", "1,000ａ"]
    assert values(spark, text.statement_key, "1. 应当还款。", "（二）x", None) == ["应当还款", "（二）x", ""]
    assert values(spark, text.cleaned_statement, "（一）应当还款；", "①A。") == ["应当还款", "A"]
    assert values(spark, text.dedup_key, "Ab-1，中文!") == ["ab1中文"]


def test_truncation(spark):
    long = "一" * 150 + "。" + "二" * 100
    got = values(spark, text.truncated, "x" * 200, "x" * 201, long, "，" + "x" * 300, "a" * 50 + "，" + "b" * 300)
    assert [len(t) for t in got] == [200, 200, 151, 200, 51]


def test_skips_and_sentences(spark):
    assert values(spark, text.skippable, "", "ab", "12-34 / 5", "详见附件", "详见" + "长" * 40, "正常的段落") == [True, True, True, True, False, False]
    assert values(spark, text.sentences, " a。b；；\n c ") == [["a", "b", "c"]]
    c = values(spark, text.constraints, "某某银行在2024年人民币贷款500万元时")[0]
    assert (c.unit, c.period, c.currency, c.subject) == ("万元", "2024年", "人民币", "某某银行")


def test_replies(spark):
    item = "struct<statement:string>"
    got = values(spark, lambda c: text.json_list(c, item), '{"items":[{"statement":"a"}]}', '[{"statement":"a"}]', '```json\n[{"statement":"a"}]\n```', 'so: [{"statement":"a"}] ok', '{"statement":"a"}', "no", None)
    assert [[x.statement for x in g] for g in got] == [["a"]] * 5 + [[], []]
    assert values(spark, text.reply_text, '{"output":"x"}', '{"choices":[{"message":{"content":"y"}}]}', "raw") == ["x", "y", "raw"]


def test_versions_and_scores(spark):
    assert values(spark, scoring.next_version, "v1.2.3", None, "x") == ["v1.2.4", "v1.0.0", "v1.0.0"]
    df = spark.createDataFrame([(0.3,), (1.7,), (None,)], "c double")
    assert [r[0] for r in df.select(scoring.confidence(F.col("c"))).collect()] == [0.3, 1.0, 0.8]


def folded(lines, limit):
    """The merge rule in plain Python."""
    out = []
    for kind, t in lines:
        if out and kind != "title" and out[-1][0] == kind:
            size, ends = len(out[-1][1]) + len(t), re.search("[。！？；;….]$", out[-1][1])
            if size <= limit or size <= 2 * limit and not ends:
                out[-1] = (kind, out[-1][1] + "\n" + t)
                continue
        out.append((kind, t))
    return out


def test_merge_and_hierarchy(spark):
    doc = "before\n# A\none.\ntwo\n\n### C\n- item\n1) item\n## B\n" + "\n".join("x" * 7 + "." * (i % 2) for i in range(9)) + "\n# D\nend"
    df = spark.createDataFrame([(1, doc), (2, ""), (3, None)], "document_id int, text string")
    lines = parsing.lines(df)
    rows = lines.where("document_id = 1").orderBy("line_no").collect()
    assert all(doc[r.start : r.end].strip().endswith(r.text) for r in rows)
    got = parsing.hierarchy(parsing.merged(lines, 20)).where("document_id = 1").orderBy("position").collect()
    assert [(r.block_type, r.text) for r in got] == folded([(r.block_type, r.text) for r in rows], 20)
    paths = {r.text.split("\n")[0]: r.section_path for r in got}
    assert (paths["before"], paths["A"], paths["one."], paths["C"], paths["- item"], paths["B"], paths["D"], paths["end"]) == ("未分类", "未分类", "A", "A", "A / C", "A", "未分类", "D")


def test_extraction_run(spark):
    blocks = spark.createDataFrame(
        [(1, "title", "第一章", None), (2, "paragraph", "借款人应当按时还款。借款人应当按时还款；不得挪用资金", None), (3, "paragraph", "详见附件", None), (4, "paragraph", "借款人应当，按时还款", None), (5, "excel_row", "q: x", "企业应当提供材料吗")],
        "block_id long, block_type string, block_text string, question string",
    )
    got = {(r.block_id, r.position): r for r in extraction.extracted(extraction.source_text(blocks).withColumn("block_text", F.col("source_text"))).collect()}
    assert {k[0] for k in got} == {2, 3, 4, 5} and len(got) == 5
    assert not got[3, 0].is_questionable and not got[4, 0].is_questionable and got[2, 0].is_questionable


def test_greedy_dedup_is_sequential(spark):
    from assaymill.plans.session import checkpoints

    checkpoints(spark)
    v = [[1.0, 0.0], [0.8, 0.6], [0.28, 0.96], [0.0, 1.0], [1.0, 0.0]]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)] + [(9, [1.0, 0.0], 1)], "item_id int, vector array<double>, grp int")
    kept = []
    for i, x in enumerate(v):
        if all(sum(a * b for a, b in zip(x, v[k], strict=True)) < 0.79 for k in kept):
            kept.append(i)
    got = {r.item_id: r.kept for r in extraction.greedy_dedup(df, 0.79).collect()}
    assert [i for i in range(5) if got[i]] == kept and got[9]


def test_gate_and_empty_coverage(spark):
    eiu = spark.createDataFrame([], "eiu_id long, block_id long, weight int, content_priority string, is_questionable boolean, review_status string, exclusion_reason string")
    covered = spark.createDataFrame([], "eiu_id long")
    row = coverage.weighted(eiu, covered).first()
    assert (row.weighted_coverage, row.p0_coverage_pct) == (0.0, 1.0)
    df = spark.createDataFrame([(0.85, 1.0, 1.0), (0.8, 0.5, 1.2)], "w double, p double, r double")
    got = df.select(*coverage.gate(F.col("w"), F.col("p"), F.col("r"))).collect()
    assert got[0].gate_passed and got[1].failures == ["weighted_coverage", "p0_coverage"]


def test_sets(spark):
    turn = "array<struct<q:string,a:string,key_turn:boolean,turn_type:string,depends_on_turns:array<int>>>"
    df = spark.createDataFrame([(1, "s", [("q1", "a1", True, "other", None), ("q2", "a2", False, None, None)], "", ""), (2, "", [], "", "")], f"case_id int, session_id string, turns {turn}, q string, a string")
    assert [r.error for r in evalsets.validated(df, True).collect()] == ["turn 1 key_turn", "missing session_id", "no turns"]
    assert [(r.q, r.a) for r in evalsets.lifted(df).orderBy("case_id").collect()] == [("q2", "a2"), ("", "")]
    items = spark.createDataFrame([(1, "doc_generated", 1, None), (2, "doc_generated", 2, None), (3, "x", None, None), (4, "public", None, 9)], "item_pos int, source string, version_id int, set_id int")
    versions = spark.createDataFrame([(1, "frozen"), (2, "draft")], "version_id int, status string")
    none = spark.createDataFrame([], "set_id int")
    assert {r.item_pos: r.error for r in evalsets.composition_errors(items, versions, none, none).collect()} == {2: "version not frozen", 3: "unknown source", 4: "public set not found"}


def test_checks_fail_closed(spark):
    df = spark.createDataFrame([(1, '[{"check_type":"answerability","passed":true,"reason":""},{"check_type":"uniqueness","passed":"no","reason":"r"}]')], "case_id int, reply string")
    got = {r.check_type: r.passed for r in quality.parsed_checks(df).collect()}
    assert len(got) == 5 and [k for k, v in got.items() if v] == ["answerability"]


def test_workflow(spark):
    docs = spark.createDataFrame([("a.md", "A", "h1"), ("b.md", "", "h2")], "file_name string, folder_path string, file_hash string")
    new = spark.createDataFrame([("x.md", None, "h1"), ("a.md", "A", "h3"), ("b.md", "B", "h4"), ("c.md", None, "h5")], "file_name string, folder_path string, file_hash string")
    got = {r.file_name: (r.status, r.action) for r in ingest.triaged(ingest.prechecked(new, docs)).collect()}
    assert got == {"x.md": ("duplicate", "skip"), "a.md": ("conflict", "confirm"), "b.md": ("elsewhere", "confirm"), "c.md": ("ok", "direct")}
    c = spark.createDataFrame([(1, 5, "What?", "candidate", "t"), (2, 6, "Why?", "retired", "t")], "case_id int, eiu_id int, question string, review_status string, review_tag string")
    revised, audit = cases.revised(c, spark.createDataFrame([(1, "New?"), (2, "No?")], "case_id int, question string"))
    assert {r.case_id: (r.question, r.review_tag) for r in revised.collect()} == {1: ("New?", None), 2: ("Why?", "t")}
    assert [r.changed_fields for r in audit.collect()] == [["question"]]
    variants = spark.createDataFrame([(1, "what ?"), (1, "How so?"), (1, "how so")], "case_id int, variant string")
    assert generation.variations(c, variants).count() == 1
    points = spark.createDataFrame([(1, 1, 7, "p", "lo"), (2, 1, 7, "p", "zz")], "case_id int, document_id int, block_id int, must_have_point string, original_text string")
    blocks = spark.createDataFrame([(7, 1, "S", "hello")], "block_id int, document_id int, section_path string, block_text string")
    ev = {r.case_id: r for r in generation.evidence(points, blocks).collect()}
    assert ev[1].points[0].start_offset == 3 and ev[2].falls_back
    samples = spark.createDataFrame([("u1", "q", ["h"]), ("u2", None, None)], "case_uid string, question string, history array<string>")
    assert {r.case_uid: r.answer for r in adapters.answered(samples).collect()}["u1"] == "mock: q"


def test_folders(spark):
    with pytest.raises(ValueError):
        folders.moved(F.col("p"), "A", "A/B")
    got = values(spark, lambda c: folders.moved(c, "A_%", "Z"), "A_%", "A_%/x", "Ab/x", "A_%b")
    assert got == ["Z", "Z/x", "Ab/x", "A_%b"]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 标题\n应当还款。", encoding="gb18030")
    (tmp_path / "b.csv").write_text("问题,答案\n何时还款,月末\n,\n", encoding="utf-8")
    (tmp_path / "c.exe").write_text("x")
    got = readers.parsed(spark, str(tmp_path)).collect()
    assert {r.block_text for r in got} == {"标题", "应当还款。", "问题: 何时还款 | 答案: 月末"}
    assert [(r.question, r.answer) for r in got if r.block_type == "excel_row"] == [("何时还款", "月末")]
    assert readers.has_header(["a", ""]) and not readers.has_header(["a1"]) and not readers.has_header(["x" * 31])
    (tmp_path / "q.json").write_text('{"qa":[{"q":"a","a":"b"}]}')
    assert readers.qa_rows(spark, str(tmp_path / "q.json"), "json").first().q == "a"
    frozen = spark.createDataFrame([(1, "u1", "q", None, None, False), (2, "u2", "q", "a", None, True)], "case_id int, case_uid string, question string, gold_answer string, evidence string, retired boolean")
    writers.write_jsonl(frozen, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"case_id":"u1","question":"q","gold_answer":null,"evidence":null}']
    cells = spark.createDataFrame([("a", 'say "x", y'), (None, "line\nend")], "one string, two string")
    for quote_all, want in ((False, b'\xef\xbb\xbfone,two\r\na,"say ""x"", y"\r\n,"line\nend"\r\n'), (True, b'\xef\xbb\xbf"one","two"\r\n"a","say ""x"", y"\r\n"","line\nend"\r\n')):
        writers.write_csv(cells.coalesce(1), str(tmp_path / f"csv{quote_all}"), quote_all=quote_all)
        assert next((tmp_path / f"csv{quote_all}").glob("*.txt")).read_bytes() == want
    got = [r.value for r in writers.csv_lines(cells.limit(0)).collect()]
    assert set(got) <= {"\ufeffone,two"}


def docx(path, paragraphs, rows):
    """A small document in Word's format."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{table}{''.join(p(*x) for x in paragraphs)}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {space}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')


def test_documents(spark, tmp_path):
    docx(tmp_path / "a.docx", [("第一章 总则",), ("应当还款。",), ("细则", "H2"), ("  ",), ("第三条 期限",), ("月末。",)], [["a", "b"], ["", ""], ["c", ""]])
    got = readers.parsed(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.block_type, r.block_text, r.section_path) for r in got] == [
        ("title", "第一章 总则", "未分类"), ("paragraph", "应当还款。", "第一章 总则"), ("title", "细则", "第一章 总则"), ("title", "第三条 期限", "第一章 总则 / 细则"),
        ("paragraph", "月末。", "第一章 总则 / 细则 / 第三条 期限"), ("table_row", "a | b\nc | ", "第一章 总则 / 细则 / 第三条 期限"),
    ]
    df = spark.createDataFrame([(16.0, 10.0, False, "t"), (13.0, 10.0, False, "t"), (12.0, 10.0, False, "t"), (10.0, 10.0, True, "t"), (10.0, 10.0, True, "t" * 40), (10.0, 10.0, False, "t")], "l double, b double, bold boolean, t string")
    assert [r[0] for r in df.select(readers.pdf_level(F.col("l"), F.col("b"), F.col("bold"), F.col("t"))).collect()] == [1, 2, 3, 3, None, None]
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    if find_spec("fitz") is None:  # a file that can't be read is never passed over in silence
        with pytest.raises(Exception, match="fitz"):
            readers.parsed(spark, str(tmp_path)).collect()
        found = readers.files(spark, str(tmp_path))
        assert [r.path.rsplit("/", 1)[1] for r in readers.undecodable(found).collect()] == ["b.pdf"]
        assert readers.parsed(spark, str(tmp_path), skip_undecodable=True).count() == 6


def test_numbers_are_dense_with_payload(spark):
    n = 1_200_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("text"))
    got = cases.numbered(rows, "i", F.col("k"))
    row = got.agg(F.countDistinct("i"), F.min("i"), F.max("i"), F.count_if(F.col("i") != F.col("k") + 1), F.countDistinct("text")).first()
    assert tuple(row) == (n, 1, n, 0, n)
    ties = cases.numbered(spark.range(5000).select(F.lit(1).alias("k"), "id"), "i", F.col("k"))
    assert ties.select("i").distinct().count() == 5000 and ties.agg(F.max("i")).first()[0] == 5000
    assert cases.numbered(rows.limit(0), "i", F.col("k")).count() == 0


def test_plugged_in_models(spark):
    df = spark.createDataFrame([("a",), (None,), ("",)], "text string")
    got = [r.embedding for r in vectors.encoded(df, lambda ts: [[3.0 * len(t), 4.0 * len(t)] for t in ts]).collect()]
    assert got[1] is None and got[2] == [0.0, 0.0] and [round(x, 4) for x in got[0]] == [0.6, 0.8]
    assert [r.embedding for r in vectors.encoded(df, None).collect()] == [None] * 3
    with pytest.raises(ValueError, match="mode"):
        generation.wanted(df, df.withColumn("is_questionable", F.lit(True)), "other")


def test_ingest_and_exchange(spark, tmp_path):
    for name, content in (("a.md", "# T\nfirst text."), ("b.txt", "second text."), ("c.txt", "second text."), ("d.exe", "x"), ("e.txt", "known")):
        (tmp_path / name).write_text(content)
    known = spark.createDataFrame([(1, "old.md", hashlib.sha256(b"known").hexdigest())], "document_id long, file_name string, file_hash string")
    got = ingest.ingested(spark, str(tmp_path), known, 10)
    assert [(r.document_id, r.file_name) for r in got.documents.orderBy("document_id").collect()] == [(10, "a.md"), (11, "b.txt")]
    assert {(r.document_id, r.block_text) for r in got.blocks.collect()} == {(10, "T"), (10, "first text."), (11, "second text.")}
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in got.refused.collect()} == {"c.txt": "duplicate", "d.exe": "extension", "e.txt": "duplicate"}
    blocks = spark.createDataFrame([(7, 1, "old"), (8, 2, "other")], "block_id long, document_id long, block_text string")
    eiu = spark.createDataFrame([(1, 7), (2, 8)], "eiu_id long, block_id long")
    case = spark.createDataFrame([(1, 1), (2, 2)], "case_id long, document_id long")
    check = spark.createDataFrame([(1,), (2,)], "case_id long")
    documents, kept, e, c, k = ingest.reuploaded(1, got, known, blocks, eiu, case, check)
    assert {r.document_id for r in documents.collect()} == {10, 11} and {r.document_id for r in kept.collect()} == {2, 10, 11}
    assert ([r.eiu_id for r in e.collect()], [r.case_id for r in c.collect()], [r.case_id for r in k.collect()]) == ([2], [2], [2])
    nothing = ingest.ingested(spark, str(tmp_path), known.unionByName(got.documents.select(known.columns)), 20)
    assert ingest.reuploaded(1, nothing, known, blocks, eiu, case, check)[0].count() == 1  # what can't be exchanged stays


def test_chat_adapter(spark):
    sent = []

    def send(request):
        sent.append(request)
        return {"choices": [{"message": {"content": "yes"}}]} if len(request["messages"]) > 1 else {}

    ask = adapters.chat(send, "m")
    assert ask("q", ["h"])["answer"] == "yes" and ask("q", [])["error"] == "no answer"
    assert [m["content"] for m in sent[0]["messages"]] == ["h", "q"]
    turn = "array<struct<q:string,key_turn:boolean>>"
    df = spark.createDataFrame([("u", [("a", False), ("b", True), ("c", None)])], f"case_uid string, turns {turn}")
    assert [(r.question, r.history) for r in adapters.asked_turns(df).collect()] == [("c", ["a"])]


def test_uploaded_questions(spark, tmp_path):
    (tmp_path / "q.txt").write_text("one?|yes|难|e|s\n|no\ntwo?|maybe|odd\n")
    got = [tuple(r) for r in readers.qa_rows(spark, str(tmp_path / "q.txt"), "txt").collect()]
    assert got == [("one?", "yes", "难", "e", "s"), ("two?", "maybe", "中等", "", "上传文件")]
    (tmp_path / "q.json").write_text('[{"question":"a","answer":"b","diff":"简单","ev":"x"},{"q":"c"}]')
    got = [tuple(r) for r in readers.qa_rows(spark, str(tmp_path / "q.json"), "json").collect()]
    assert got == [("a", "b", "简单", "x", "上传文件"), ("c", "", "中等", "", "上传文件")]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_few_items_go_to_all_tasks(spark):
    """a composition's few keys don't gather all samples in one task."""
    items = spark.createDataFrame([(1, "doc_generated", 7, None, None)], "item_pos int, source string, version_id long, set_id long, dimension string")
    rows = spark.range(1000).selectExpr("cast(id AS string) AS case_uid", "'doc_generated' AS source", "7L AS ref_id", "'' AS dimension")
    for distinct in (False, True):
        made = evalsets.composed(items, rows, distinct)
        assert "SortMergeJoin" not in plan(made) and made.count() == 1000


def test_keys_are_dealt_to_all_parts(spark):
    """parts aren't merged by their bytes, which say little of keys in a row."""
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(50, 200).withColumnRenamed("id", "k")
    for f, n in ((lookups.shared_keys, 50), (lookups.missing_keys, 50)):
        assert "REPARTITION_BY_NUM" in plan(f(a, b, "k")) and f(a, b, "k").count() == n


def test_searches_are_made_once_or_not_at_all(spark):
    """what can't hold for a text isn't looked for."""
    assert values(spark, lambda c: text.classified(c)["eiu_type"], "plain words only", "a = b and c", "abc", None) == ["rule", "formula", None, None]
    assert values(spark, lambda c: text.constraints(c)["condition"], "客户逾期时须还款", "no such words at all", None) == ["客户逾期时", None, None]
    one = spark.createDataFrame([("a",)], "t string")
    assert plan(one.select(text.constraints(F.col("t"))["condition"])).split("Physical Plan")[1].count("时|的") <= 2
    assert "contains(t" in plan(one.select(text.json_list(F.col("t"), "struct<a:int>"))).lower()
    assert values(spark, lambda c: F.size(text.json_list(c, "struct<a:int>")), "```json\nplain\n```", '```json\n[{"a":1}]\n```', '{"items":[{"a":1}]}', 'x [{"a":1}] y', None) == [0, 1, 1, 1, 0]
