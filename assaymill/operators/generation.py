"""Cases from statements: evidence, checking context, questions by a pluggable generator, variations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.records import question_type
from assaymill.functions.scoring import difficulty
from assaymill.functions.text import question_key

#: Question angles by name; a generator words a question from a statement.
Generator = Callable[[Column, Column], Column]


def template(statement: Column, angle: Column) -> Column:
    """Without a model: the statement itself, asked for under its angle."""
    return F.concat(F.lit("["), angle, F.lit("] "), statement)


def evidence(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """(case_id, points): answer points whose quoted text stands in a block of the case's document, with their offsets.

    Where any point of a case lacks valid evidence, the whole case falls back to its source block.
    """
    known = blocks.select("block_id", "document_id", "section_path", "block_text")
    rows = points.join(known, ["document_id", "block_id"], "left")
    good = F.coalesce((F.trim(F.coalesce("must_have_point", F.lit(""))) != "") & (F.coalesce("original_text", F.lit("")) != "") & F.contains("block_text", F.col("original_text")), F.lit(False))
    pos = F.position(F.col("original_text"), F.col("block_text")) - 1
    item = F.struct(
        F.trim("must_have_point").alias("must_have_point"), "block_id", "section_path", "original_text", pos.alias("start_offset"), (pos + F.length("original_text")).alias("end_offset")
    )
    cases = rows.groupBy("case_id").agg(F.bool_and(good).alias("valid"), F.sort_array(F.collect_list(item)).alias("points"))
    return cases.select("case_id", F.when(F.col("valid"), F.col("points")).alias("points"), (~F.col("valid")).alias("falls_back"))


def source_block(eiu: DataFrame, blocks: DataFrame) -> DataFrame:
    """(eiu_id, block_id): the first evidence block that exists in the statement's document."""
    ids = eiu.select("eiu_id", "document_id", F.posexplode("evidence_blocks").alias("pos", "block_id"))
    return ids.join(blocks.select("block_id", "document_id"), ["block_id", "document_id"]).groupBy("eiu_id").agg(F.min_by("block_id", "pos").alias("block_id"))


def checking_context(cases: DataFrame, eiu: DataFrame) -> DataFrame:
    """(case_id, context): the statement and the quoted evidence of a case, 500 characters at most."""
    rows = cases.join(eiu.select("eiu_id", "statement"), "eiu_id", "left")
    return rows.select("case_id", F.substring(F.concat_ws("\n", "statement", F.array_join(F.coalesce("quotes", F.array().cast("array<string>")), "\n")), 1, 500).alias("context"))


def usable_source(eiu: DataFrame, blocks: DataFrame) -> DataFrame:
    """(eiu_id, block_id): the first evidence block that exists and is no title; the last one listed even if it is one."""
    ids = eiu.select("eiu_id", F.posexplode("evidence_blocks").alias("pos", "block_id"), (F.size("evidence_blocks") - 1).alias("last"))
    hit = ids.join(blocks.select("block_id", "block_type"), "block_id").where((F.col("block_type") != "title") | (F.col("pos") == F.col("last")))
    return hit.groupBy("eiu_id").agg(F.min_by("block_id", "pos").alias("block_id"))


def wanted(eiu: DataFrame, cases: DataFrame, mode: str = "missing", document_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements to ask about, cases that stay): ``missing`` leaves statements with a live case alone, ``rebuild`` drops
    the cases of the chosen document, or all, and asks about each of its statements again."""
    if mode not in ("missing", "rebuild"):
        raise ValueError(f"unknown mode: {mode}")
    some = eiu.where("is_questionable") if document_id is None else eiu.where("is_questionable").where(F.col("document_id") == document_id)
    if mode == "missing":
        return some.join(cases.where(F.coalesce("review_status", F.lit("")) != "retired").select("eiu_id"), "eiu_id", "left_anti"), cases
    return some, cases.limit(0) if document_id is None else cases.where(~F.coalesce(F.col("document_id") == document_id, F.lit(False)))


def prompt(kind: str, **parts: Column) -> Column:
    """The text for a model: what it is to do, then each given part under its name; empty parts are left out."""
    named = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in parts.items()]
    return F.concat_ws("\n", F.lit(PROMPTS[kind]), *named)


#: What a model is asked to do, by the kind of prompt; replies are JSON arrays, which ``functions.text.json_list`` reads.
PROMPTS = {
    "extraction": "List the testable statements of the text as a JSON array of objects with statement, eiu_type, content_priority, is_questionable and exclusion_reason.",
    "question": "Write one question, with its answer, that the statement answers under the angle, as a JSON array of objects with question and gold_answer.",
    "variation": "Write the question in other words, with the same answer, as a JSON array of objects with question and style.",
    "check": "Judge the question and answer against the context, as a JSON array of objects with check_type, passed and reason.",
}


def generated(eiu: DataFrame, angles: list[str], generator: Generator = template) -> DataFrame:
    """One candidate case for each statement and angle."""
    rows = eiu.where("is_questionable").withColumn("angle", F.explode(F.array(*map(F.lit, angles))))
    return rows.select(
        "eiu_id", "angle", generator(F.col("statement"), F.col("angle")).alias("question"), F.col("statement").alias("gold_answer"), question_type(F.col("eiu_type")).alias("question_type"),
        difficulty(F.col("eiu_type"), F.col("content_priority")).alias("difficulty"), "content_priority", F.lit("candidate").alias("review_status"),
    )


def variations(cases: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants (case_id, variant) of cases with the same answer; those that ask the same question again are dropped."""
    rows = variants.join(cases, "case_id")
    key = question_key(F.col("variant"))
    fresh = rows.where((key != question_key(F.col("question"))) & (key != "")).withColumn("_key", key)
    first = fresh.groupBy("case_id", "_key").agg(F.min("variant").alias("question"))
    return first.join(cases.drop("question"), "case_id").drop("_key").withColumn("review_status", F.lit("candidate"))


def passing(made: DataFrame, checks: DataFrame, hard: list[str] = S.HARD_CHECKS) -> DataFrame:
    """Variants with their status after checks: those that fail a hard check are retired, the others stay as they are."""
    bad = checks.where(F.col("check_type").isin(hard) & ~F.coalesce("passed", F.lit(False))).select("case_id", F.lit(True).alias("_bad")).distinct()
    out = made.join(bad, "case_id", "left")
    return out.withColumn("review_status", F.when(F.col("_bad"), "retired").otherwise(F.col("review_status"))).drop("_bad")


def results(made: DataFrame) -> DataFrame:
    """How many generations worked and failed."""
    return made.agg(F.count_if(F.col("error").isNull()).alias("generated"), F.count_if(F.col("error").isNotNull()).alias("failed"))
