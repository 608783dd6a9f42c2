"""Edits by hand: validated patches of statements, deletions, moves and new names, each with its audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.requests import statement_edit
from assaymill.functions.scoring import mapped
from assaymill.operators.cases import blocked, patched

PATCH = ["statement", "eiu_type", "content_priority", "is_questionable", "exclusion_reason", "constraints", "extraction_confidence"]


def audit(rows: DataFrame, operation: str, target: str, key: str, fields: Column, actor: str = "api") -> DataFrame:
    """(operation, target_type, target_id, actor, fields) of each row."""
    return rows.select(F.lit(operation).alias("operation"), F.lit(target).alias("target_type"), F.col(key).cast("string").alias("target_id"), F.lit(actor).alias("actor"), fields.alias("fields"))


def edited(eiu: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, audit, refused) after patches by eiu_id, one of each statement; null fields stay as they are.

    A priority sets its weight, asking again clears the reason, and ending that needs one, given now or before.
    ``refused``: (eiu_id, problems); a patch with any problem changes nothing, nor does one of an unknown statement.
    """
    known = eiu.select("eiu_id", F.col("exclusion_reason").alias("_reason"), F.lit(True).alias("_known"))
    rows = patches.join(known, "eiu_id", "left")
    silent = ~F.coalesce("is_questionable", F.lit(True)) & (F.coalesce(F.nullif(F.col("exclusion_reason"), F.lit("")), F.nullif(F.col("_reason"), F.lit(""))).isNull())
    found = F.array_compact(F.concat(F.array(F.when(F.col("_known").isNull(), "eiu_id")), statement_edit(), F.array(F.when(silent, "exclusion_reason"))))
    rows = rows.withColumn("problems", F.array_distinct(found))
    good = rows.where(F.size("problems") == 0)
    cleared = F.coalesce("is_questionable", F.lit(False)) & F.col("exclusion_reason").isNull()
    change = good.select(
        "eiu_id", *PATCH, mapped(F.col("content_priority"), S.PRIORITY_WEIGHT, F.lit(None)).cast(eiu.schema["weight"].dataType).alias("weight"), F.when(cleared, F.array(F.lit("exclusion_reason"))).alias("set_null")
    )
    names = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in PATCH] + [F.when(F.col("content_priority").isNotNull(), F.lit("weight")), F.when(F.col("is_questionable"), F.lit("exclusion_reason"))]
    fields = F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))
    return patched(eiu, change, "eiu_id", ("exclusion_reason",)), audit(good, "update", "eiu", "eiu_id", fields), rows.where(F.size("problems") > 0).select("eiu_id", "problems")


def deleted(eiu: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, audit): known statements among the keys are blocked."""
    known = keys.select("eiu_id").distinct().join(eiu.select("eiu_id"), "eiu_id", "left_semi")
    return blocked(eiu, known), audit(known, "delete", "eiu", "eiu_id", F.array(F.lit("review_status")))


def moved_document(documents: DataFrame, document_id: int, folder: str | None, purpose: str | None = None) -> DataFrame:
    """One document in another folder, the root as the empty string; without a purpose it is a basic one."""
    hit = F.col("document_id") == document_id
    new = {"folder_path": (folder or "").strip("/"), "purpose": purpose or "basic"}
    return documents.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in new.items()})


def renamed(rows: DataFrame, key: str, value: int, column: str, name: str) -> DataFrame:
    """One row under another name; a blank one is refused."""
    if not name.strip():
        raise ValueError("a name can't be blank")
    return rows.withColumn(column, F.when(F.col(key) == value, F.lit(name.strip())).otherwise(F.col(column)))


def moved_case(cases: DataFrame, case_id: int, folder: str | None) -> DataFrame:
    return cases.withColumn("folder_path", F.when(F.col("case_id") == case_id, F.lit((folder or "").strip("/"))).otherwise(F.col("folder_path")))


def without_cases(cases: DataFrame, document_id: int | None = None, case_id: int | None = None) -> DataFrame:
    """Cases without one of them, or without those of a document."""
    gone = F.lit(False)
    for c, v in (("document_id", document_id), ("case_id", case_id)):
        gone = gone | F.coalesce(F.col(c) == v, F.lit(False)) if v is not None else gone
    return cases.where(~gone)
