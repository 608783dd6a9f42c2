"""Exports of versions and candidate cases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.records import difficulty_label, evidence_sections
from assaymill.operators.cases import filter_cases, page
from assaymill.operators.folders import inside
from assaymill.operators.quality import by_case, by_check_type, summary


def jsonl_rows(cases: DataFrame, limit: int | None = S.PAGE) -> DataFrame:
    """A JSON line per live case; ``limit`` None takes all."""
    live = cases.where(~F.coalesce("retired", F.lit(False)))
    rows = page(live, F.col("case_id"), limit=limit) if limit else live
    return rows.select(F.to_json(F.struct(F.col("case_uid").alias("case_id"), "question", "gold_answer", "evidence"), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(cases: DataFrame, path: str, limit: int | None = S.PAGE) -> None:
    jsonl_rows(cases, limit).write.mode("overwrite").text(path)


def nested(cases: DataFrame, statements: DataFrame) -> DataFrame:
    """(document_name, sections): each document's sections with their cases, by the case's first statement."""
    first = cases.withColumn("eiu_id", F.try_element_at("eiu_ids", F.lit(1))).join(statements.select("eiu_id", "section_path", "document_name"), "eiu_id", "left")
    rows = first.select(F.coalesce("document_name", F.lit(S.NO_DOCUMENT)).alias("document_name"), F.coalesce("section_path", F.lit(S.UNFILED)).alias("section_path"), F.struct("case_uid", "question", "gold_answer").alias("c"))
    sections = rows.groupBy("document_name", "section_path").agg(F.sort_array(F.collect_list("c")).alias("cases"))
    return sections.groupBy("document_name").agg(F.sort_array(F.collect_list(F.struct("section_path", "cases"))).alias("sections"))


def csv_lines(rows: DataFrame, header: list[str] | None = None, quote_all: bool = False) -> DataFrame:
    """(value): lines of CSV, each partition with the byte order mark and a header first, so that every part file is whole.

    Cells are quoted where they hold a comma, a quote or a line end, or all of them; nulls are empty cells.
    """
    names, lines = header or rows.columns, rows.select(F.concat_ws(",", *[cell(F.col(c), quote_all) for c in rows.columns]).alias("value"))
    head = "\ufeff" + ",".join('"' + n.replace('"', '""') + '"' if quote_all else n for n in names)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        schema = pa.schema([("value", pa.string())]) if first is None else first.schema
        yield pa.RecordBatch.from_arrays([pa.array([head], schema[0].type)], schema=schema)
        if first is not None:
            yield first
            yield from batches

    return lines.mapInArrow(go, "value string")


def cell(c: Column, quote_all: bool) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if quote_all else F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def write_csv(rows: DataFrame, path: str, header: list[str] | None = None, quote_all: bool = False) -> None:
    """Part files of CSV with a byte order mark, a header and CRLF ends."""
    csv_lines(rows, header, quote_all).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def version_rows(cases: DataFrame) -> DataFrame:
    """The eight columns of a version's export."""
    return cases.select(F.col("case_uid").alias("case_id"), *S.CSV_COLUMNS[1:])


def question_rows(cases: DataFrame) -> DataFrame:
    """Questions and answers as a user sees them, under the header of the upload template."""
    return cases.select("question", "gold_answer", difficulty_label(F.col("difficulty")).alias("difficulty"), evidence_sections(F.col("evidence")).alias("evidence"), "document_name")


def template_lines() -> list[str]:
    """The template for uploads: its header, split at pipes."""
    return ["|".join(S.QA_HEADER)]


def folder_rows(cases: DataFrame, folder: str, recursive: bool = True) -> DataFrame:
    """Cases of a folder, and below it if wanted, with the parts of their path."""
    path = F.coalesce("folder_path", F.lit(""))
    hit = inside(path, folder) if recursive and folder else F.lit(True) if recursive else path == folder
    return cases.where(hit).withColumn("path_parts", F.filter(F.split(path, "/"), lambda x: x != ""))


def folder_tree(cases: DataFrame, folder: str = "", recursive: bool = True) -> DataFrame:
    """(purpose, depth, path, parent, files, total): a row per folder of an export, roots by purpose, with its own cases.

    Folders on the way to one with cases are there too; ``total`` is the number of cases of the whole export.
    """
    rows = folder_rows(cases, folder, recursive).withColumn("purpose", F.when(F.col("purpose") == "gen", S.PURPOSE_LABELS["gen"]).otherwise(S.PURPOSE_LABELS["basic"]))
    above = F.transform(F.sequence(F.lit(0), F.size("path_parts")), lambda i: F.array_join(F.slice("path_parts", 1, i), "/"))
    own = F.array_join("path_parts", "/")
    placed = rows.select("purpose", F.explode(above).alias("path"), own.alias("own"), F.struct("case_id", "question", "gold_answer").alias("c"))
    files = placed.groupBy("purpose", "path").agg(F.sort_array(F.collect_list(F.when(F.col("path") == F.col("own"), F.col("c")))).alias("files"))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    parent = F.when(F.col("path") != "", F.regexp_replace("path", "/?[^/]*$", ""))
    return files.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))).select("purpose", depth.alias("depth"), "path", parent.alias("parent"), "files", "total")


def case_objects(cases: DataFrame, document_id: int | None = None, difficulty: str | None = None, status: str | None = None) -> DataFrame:
    """(case_id, value): cases as JSON objects, filtered where asked; their count goes with the files, not in them."""
    rows = filter_cases(cases, document_id=document_id, difficulty=difficulty, review_status=status)
    return rows.select("case_id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def markdown(cases: DataFrame) -> DataFrame:
    """(case_id, value): a section of Markdown for each case, with its points and where its first evidence stands."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    first = F.try_element_at("evidence", F.lit(1)) if "evidence" in cases.columns else F.lit(None)
    head = F.concat(F.lit("## "), F.col("case_id").cast("string"), F.lit(" · "), F.coalesce("question", F.lit("")))
    kind = F.concat(F.lit(S.CASE_KIND), text("question_type"), F.lit(S.CASE_LEVEL), text("difficulty"), F.lit(S.CASE_PRIORITY), text("content_priority"), F.lit(S.CASE_STATUS), text("review_status"))
    points = F.col("must_have_points") if "must_have_points" in cases.columns else F.lit(None).cast("array<string>")
    listed = F.when(F.size(points) > 0, F.concat(F.lit(S.CASE_POINTS + "\n  - "), F.array_join(points, "\n  - ")))
    where = None
    if "evidence" in cases.columns:
        where = F.when(first.isNotNull(), F.concat(
            F.lit(S.CASE_PLACE), F.coalesce(first["section_path"], F.lit(S.UNFILED)), F.lit(" page "), F.coalesce(first["page_no"].cast("string"), F.lit("?")),
            F.lit(" (block "), first["block_id"].cast("string"), F.lit(") "), F.coalesce(first["document_name"], F.lit("")),
        ))
    lines = [head, kind, F.concat(F.lit(S.CASE_ANSWER), text("gold_answer")), listed, *([where] if where is not None else [])]
    return cases.select("case_id", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value"))


def quality_report(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """(part, position, value): lines of a report on checks: totals, a row per kind of check, and each failed case."""
    total = summary(cases, checks).select(
        F.lit(0).alias("part"), F.lit(0).cast("long").alias("position"),
        F.format_string(S.REPORT_HEAD, "checked", "passed", "failed").alias("value"),
    )
    kinds = by_check_type(checks).select(
        F.lit(1).alias("part"), F.row_number().over(Window.orderBy("check_type")).cast("long").alias("position"), F.format_string("| %s | %d | %d |", "check_type", "passed", "failed").alias("value")
    )  # a row for each kind of check
    bad = checks.where(~F.coalesce("passed", F.lit(False))).groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list("check_type")), ", ").alias("names"))
    failed = by_case(checks).join(bad, "case_id").select(
        F.lit(2).alias("part"), F.col("case_id").cast("long").alias("position"), F.format_string("- case %d：%s\n  - %s", F.col("case_id").cast("long"), "names", "reasons").alias("value")
    )
    return total.unionByName(kinds).unionByName(failed)


def stored_files(found: DataFrame, root: str) -> DataFrame:
    """(path, stored_path): where raw files go, under a random prefix of twelve hexadecimal digits."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    prefix = F.substring(F.replace(F.uuid(), F.lit("-")), 1, 12)
    return found.select("path", F.concat(F.lit(root.rstrip("/") + "/"), prefix, F.lit("_"), name).alias("stored_path"))


def migrated(rows: DataFrame, wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows in the wanted columns: missing ones null, old ones dropped, a null document filled from the block."""
    out = wanted.limit(0).unionByName(rows.select([c for c in rows.columns if c in wanted.columns]), allowMissingColumns=True)
    fill = out.join(blocks.select("block_id", F.col("document_id").alias("_d")), "block_id", "left")
    return fill.withColumn("document_id", F.coalesce("document_id", "_d")).select(wanted.columns)
