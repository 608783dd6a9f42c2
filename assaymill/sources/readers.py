"""Readers of the formats that documents come in; binary decoders are used where their libraries are installed."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from importlib.util import find_spec
from pathlib import PurePosixPath
from statistics import median
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.operators.parsing import hierarchy, lines, merged

BLOCK = "path string, position int, section_path string, block_type string, block_text string, parent_position int, page_no int, start long, end long, question string, answer string"


def decoded(raw: bytes) -> str:
    """Text of bytes in the first encoding that fits; the last one always does."""
    for name in ("utf-8", "utf-8-sig", "gb18030"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of accepted files: known extension, at most the size limit."""
    return accepted_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def accepted_files(raw: DataFrame) -> DataFrame:
    """Those of some files, and their ``suffix``."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return raw.where(suffix.isin(S.UPLOAD_EXTENSIONS) & (F.col("length") <= S.MAX_FILE_BYTES)).withColumn("suffix", suffix)


def texts(found: DataFrame) -> DataFrame:
    """(path, text) of text and Markdown files."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b.path, "text": [decoded(x) for x in b.content]})

    return found.where(F.col("suffix").isin(".txt", ".md")).select("path", "content").mapInPandas(go, "path string, text string")


def text_blocks(rows: DataFrame, key: str = "path") -> DataFrame:
    """Blocks of texts: lines classified, neighbours merged, headings above."""
    out = hierarchy(merged(lines(rows, key)))
    none = F.lit(None)
    return out.select(
        F.col("document_id").alias("path"), "position", "section_path", "block_type", F.col("text").alias("block_text"), "parent_position", none.cast("int").alias("page_no"),
        "start", "end", none.cast("string").alias("question"), none.cast("string").alias("answer"),
    )


def has_header(cells: list[str]) -> bool:
    """A first row of short texts without digits names the columns."""
    named = [c for c in cells if c]
    return bool(named) and all(len(c) <= 30 and not any(x.isdigit() for x in c) for c in named)


def table_blocks(rows: list[list[str]], sheet: str) -> Iterator[tuple[str, str | None, str | None]]:
    """(text, question, answer) of each row of a table that isn't empty."""
    if len(rows) > S.MAX_TABLE_ROWS or len(rows) * max(map(len, rows), default=0) > S.MAX_TABLE_CELLS:
        raise ValueError(f"table {sheet} has too many rows or cells")
    rows = [r for r in rows if any(r)]
    header = rows[0] if rows and has_header(rows[0]) else []
    for row in rows[bool(header) :]:
        names = [header[i] if i < len(header) and header[i] else f"列{i + 1}" for i in range(len(row))]
        special = {k: next((v for n, v in reversed([*zip(names, row, strict=True)]) if any(w in n.lower() for w in words)), None) for k, words in (("q", ("问题", "question")), ("a", ("答案", "answer")))}
        yield " | ".join(f"{n}: {v}" if header else v for n, v in zip(names, row, strict=True)), special["q"], special["a"]


def read_csv(raw: bytes) -> tuple[str, list[list[str]]]:
    return "表格", [[c.strip() for c in r] for r in csv.reader(io.StringIO(decoded(raw)))]


def read_xlsx(raw: bytes) -> tuple[str, list[list[str]]]:
    import openpyxl  # optional

    sheet = openpyxl.load_workbook(io.BytesIO(raw), read_only=True, data_only=True).active
    return sheet.title or "表格", [["" if c is None else str(c).strip() for c in r] for r in sheet.iter_rows(values_only=True)]


TABLES: dict[str, Callable[[bytes], tuple[str, list[list[str]]]]] = {".csv": read_csv, ".xlsx": read_xlsx}


def tabular_blocks(found: DataFrame) -> DataFrame:
    """One block per row of CSV and XLSX files; a file holds at most the row limit, so it is read by one task."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                sheet, rows = TABLES[PurePosixPath(path).suffix.lower()](content)
                made = [(path, i, sheet, "excel_row", t, None, None, None, None, q, a) for i, (t, q, a) in enumerate(table_blocks(rows, sheet))]
                yield pd.DataFrame(made, columns=[x.split()[0] for x in BLOCK.split(", ")])

    return found.where(F.col("suffix").isin(list(TABLES))).select("path", "content").mapInPandas(go, BLOCK)


#: A paragraph, table row or page block of a document, before its kind is decided.
PART = "path string, position int, page_no int, style string, text string, largest double, body double, bold boolean"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(raw: bytes) -> Iterator[tuple]:
    """Paragraphs with their styles' names, then the rows of all tables with the style ``table_row``."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else []
    # names of headings are stored in lower case
    names = {s.get(f"{WORD}styleId"): re.sub("^heading", "Heading", n.get(f"{WORD}val")) for s in styles if (n := s.find(f"{WORD}name")) is not None}
    text = lambda node: "".join({f"{WORD}t": t.text or "", f"{WORD}tab": "\t", f"{WORD}br": "\n"}.get(t.tag, "") for t in node.iter())
    paragraphs, tables = body.findall(f"{WORD}p"), body.findall(f"{WORD}tbl")
    rows = [[" ".join(filter(None, map(str.strip, map(text, cell.iter(f"{WORD}p"))))) for cell in row.findall(f"{WORD}tc")] for t in tables for row in t.findall(f"{WORD}tr")]
    if len(paragraphs) + sum(map(len, rows)) > S.MAX_DOCX_ELEMENTS:
        raise ValueError("the document has too many paragraphs or cells")
    for p in paragraphs:
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        yield None, names.get(style.get(f"{WORD}val"), "") if style is not None else "", text(p).strip(), None, None, None
    for cells in rows:
        if any(cells):
            yield None, "table_row", " | ".join(cells), None, None, None


def read_pdf(raw: bytes) -> Iterator[tuple]:
    """Blocks of each page with their largest letters, the page's middle size, and whether any part is bold."""
    import fitz  # optional

    with fitz.open(stream=raw, filetype="pdf") as doc:
        if doc.page_count > S.MAX_PDF_PAGES:
            raise ValueError("the document has too many pages")
        for number, page in enumerate(doc, 1):
            blocks = [[s for line in b["lines"] for s in line["spans"]] for b in page.get_text("dict")["blocks"] if b.get("type") == 0]
            body = median([s["size"] for b in blocks for s in b] or [11.0])
            for spans in blocks:
                text = "".join(s["text"] for s in spans).strip()
                yield number, "", text, max((s["size"] for s in spans), default=0.0), body, any(s.get("flags", 0) & 16 for s in spans)


DECODERS: dict[str, Callable[[bytes], Iterator[tuple]]] = {".docx": read_docx, ".pdf": read_pdf}


def decoded_parts(found: DataFrame) -> DataFrame:
    """The parts of DOCX and PDF files that aren't empty; a file whose decoder isn't installed ends the job with an error."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                parts = [x for x in DECODERS[PurePosixPath(path).suffix.lower()](content) if x[2]]
                yield pd.DataFrame([(path, i, *x) for i, x in enumerate(parts)], columns=[x.split()[0] for x in PART.split(", ")]).astype({"page_no": "Int32"})

    return found.where(F.col("suffix").isin(list(DECODERS))).select("path", "content").mapInPandas(go, PART)


def docx_level(style: Column, text: Column) -> Column:
    """Level of a paragraph: that of its heading style, else by the chapter words that it starts with."""
    # Chapter words and their levels, in the order in which they are tried.
    number = "[一二三四五六七八九十百千零两]+"
    patterns = [(f"^第{number}\\s*章", 1), (f"^第{number}\\s*[节部分]", 2), (f"^第{number}\\s*条", 3), ("^(?:附件|附录)", 2)]
    heading = F.regexp_extract(style, r"^Heading\s+(\d+)", 1)
    out = F.when(style == "table_row", None).when(heading != "", heading.try_cast("int"))
    for pattern, level in patterns:
        out = out.when(text.rlike(pattern), F.lit(level))
    return out


def pdf_level(largest: Column, body: Column, bold: Column, text: Column) -> Column:
    """Level of a block whose letters are a fifth larger than the page's, or bold and short; null for plain text."""
    ratio = F.try_divide(largest, body)
    title = (ratio >= 1.2) | (bold & (F.length(text) < 40))
    return F.when(title, F.when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).otherwise(3))


def document_blocks(found: DataFrame) -> DataFrame:
    """Blocks of DOCX and PDF files, merged and under their headings like those of texts."""
    parts = decoded_parts(found)
    level = F.when(F.col("body").isNotNull(), pdf_level(F.col("largest"), F.col("body"), F.col("bold"), F.col("text"))).otherwise(docx_level(F.col("style"), F.col("text")))
    kind = F.when(F.col("style") == "table_row", "table_row").when(level.isNotNull(), "title").otherwise("paragraph")
    none = F.lit(None).cast("long")
    lines_ = parts.select(F.col("path").alias("document_id"), F.col("position").alias("line_no"), kind.alias("block_type"), level.cast("int").alias("level"), "text", none.alias("start"), none.alias("end"))
    pages = parts.select("path", F.col("position").alias("line_no"), "page_no")
    # a merged block keeps the page of its first part
    out = hierarchy(merged(lines_, keep_line=True)).join(pages.withColumnRenamed("path", "document_id"), ["document_id", "line_no"], "left")
    text = F.lit(None).cast("string")
    return out.select(
        F.col("document_id").alias("path"), "position", "section_path", "block_type", F.col("text").alias("block_text"), "parent_position", "page_no", "start", "end",
        text.alias("question"), text.alias("answer"),
    )


def undecodable(found: DataFrame) -> DataFrame:
    """(path, reason) of accepted files whose decoder isn't installed here, to be left out before parsing."""
    missing = [suffix for suffix, module in ((".pdf", "fitz"), (".xlsx", "openpyxl")) if find_spec(module) is None]
    return found.where(F.col("suffix").isin(missing)).select("path", F.lit("no decoder").alias("reason"))


def parsed(spark: SparkSession, path: str, skip_undecodable: bool = False) -> DataFrame:
    """Blocks of all accepted files under a path, in one shape. Files without a decoder end the job, or are left out if asked."""
    found = files(spark, path)
    found = found.join(undecodable(found).select("path"), "path", "left_anti") if skip_undecodable else found
    return blocks_of(found)


def blocks_of(found: DataFrame) -> DataFrame:
    """Blocks of accepted files, each by its kind."""
    return text_blocks(texts(found)).unionByName(tabular_blocks(found)).unionByName(document_blocks(found))


def qa_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(q, a, difficulty, evidence, source) of an uploaded file: JSON (an array, or under ``qa`` or ``questions``), or lines
    split at pipes, of which those without a question go. Unknown difficulties are the middle one."""
    names = ["q", "a", "difficulty", "evidence", "source"]
    levels = list(dict.fromkeys(S.DIFFICULTY_LABELS.values()))
    if kind == "json":
        fields = {"q": ("q", "question"), "a": ("a", "answer"), "difficulty": ("diff",), "evidence": ("evidence", "ev"), "source": ("src", "source")}
        item = f"array<struct<{','.join(f'{f}:string' for some in fields.values() for f in some)}>>"
        raw = spark.read.text(path, wholetext=True)
        rows = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", item)), F.from_json(F.get_json_object("value", "$.qa"), item), F.from_json(F.get_json_object("value", "$.questions"), item))
        found = raw.select(F.explode(rows).alias("r")).select(*[F.coalesce(*[F.nullif(F.col(f"r.{f}"), F.lit("")) for f in some], F.lit("")).alias(n) for n, some in fields.items()])
    else:
        parts = F.split("value", r"\|")
        found = spark.read.text(path).select(*[F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)]).where("q <> ''")
    known = F.when(F.col("difficulty").isin(levels), F.col("difficulty")).otherwise(S.DIFFICULTY_LABELS["L2"])
    return found.withColumns({"difficulty": known, "source": F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(S.UPLOADED_FILE))})


def seed_blocks(points: DataFrame) -> DataFrame:
    """One block per distinct document and block of a list of knowledge points."""
    return points.dropDuplicates(["document_id", "block_id"]).select("document_id", "block_id", "section_path", F.lit("paragraph").alias("block_type"), "block_text")
