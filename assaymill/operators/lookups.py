"""Lists and searches: lookups by key, name or place, row gates, column filters, commands, set operations, counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.text import tokens


def by_key(df: DataFrame, **keys) -> DataFrame:
    """The rows of a key: none or one where it is unique."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def of_parent(df: DataFrame, parent: str, value: int, key: str) -> DataFrame:
    """The rows that hang on one other, in order of their own keys."""
    return by_key(df, **{parent: value}).orderBy(key)


def newest(df: DataFrame, key: str, limit: int | None = S.PAGE, offset: int = 0) -> DataFrame:
    """A catalogue, newest first; ``limit`` None takes all."""
    rows = df.orderBy(F.col(key).desc())
    return rows.offset(offset).limit(limit) if limit else rows


def documents_by_hash(documents: DataFrame, digest: str) -> DataFrame:
    return by_key(documents, file_hash=digest)


def documents_in_folder(documents: DataFrame, folder: str | None = None, name: str | None = None) -> DataFrame:
    """Documents of one folder, the root where it is null or empty, and of one name where it is given."""
    rows = documents.where(F.coalesce("folder_path", F.lit("")) == (folder or ""))
    return rows if name is None else by_key(rows, file_name=name)


def documents_named(documents: DataFrame, name: str) -> DataFrame:
    """Documents of a name, wherever they are."""
    return by_key(documents, file_name=name)


def enabled_dimensions(dimensions: DataFrame) -> DataFrame:
    return dimensions.where(F.col("enabled").cast("int") == 1)


def public_sets(sets: DataFrame, include_retired: bool = False) -> DataFrame:
    return sets if include_retired else by_key(sets, status="active")


def accepted(question: Column, answer: Column, evidence: Column) -> Column:
    """Whether a row passes: a question, an answer of some length, and evidence that isn't a dash."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return has(question) & (F.length(F.coalesce(answer, F.lit(""))) >= S.LEAST_ANSWER) & has(evidence) & (F.coalesce(evidence, F.lit("")) != S.DASH)


def values_of(df: DataFrame, column: str) -> DataFrame:
    """The distinct values that a column's filter offers; empty ones as a dash."""
    return df.select(F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(S.DASH)).alias("value")).distinct()


def with_values(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return df.where(F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(S.DASH)).isin(keep))


def searched(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows that hold a text anywhere in their columns, whatever the case."""
    whole = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns or df.columns])
    return df.where(F.contains(F.lower(whole), F.lit(text.strip().lower())))


def pages(df: DataFrame, size: int = S.PAGER) -> DataFrame:
    """One row: how many pages a list has."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("pages"))


def commanded(cases: DataFrame, text: str) -> DataFrame:
    """Cases that a sentence names: by the word for a difficulty and by the name of a document in it; without either, all."""
    hit = F.lit(True)
    level = next((w for w in dict.fromkeys(S.DIFFICULTY_LABELS.values()) if w in text), None)
    if level:
        hit = F.col("difficulty").isin([k for k, v in S.DIFFICULTY_LABELS.items() if v == level])
    named = cases.where(F.contains(F.lit(text), F.col("document_name")) & (F.col("document_name") != "")).select("document_name").distinct()
    name = named.agg(F.min("document_name").alias("_name"))  # one row
    return cases.where(hit).join(F.broadcast(name), F.col("_name").isNull() | (F.col("document_name") == F.col("_name"))).drop("_name")


def deleted_by_command(cases: DataFrame, text: str) -> DataFrame:
    """Cases that stay after a sentence asks to delete the one whose number, Q-n, it names."""
    m = re.search(r"Q-(\d+)", text, re.IGNORECASE)
    return cases if m is None else cases.where(F.col("case_id") != int(m[1]))


def to_check(cases: DataFrame) -> DataFrame:
    """Cases that a round of checks takes, with ``turn``: candidates first, then those in need of review."""
    turn = F.when(F.col("review_status") == "candidate", 0).when(F.col("review_status") == "needs_review", 1)
    return cases.withColumn("turn", turn).where("turn IS NOT NULL")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """The keys in as many parts as the session's shuffles have: keys in a row shrink so well that parts merged by their bytes would hold nearly all."""
    return rows.select(key).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return _dealt(a, key).distinct().join(_dealt(b, key), key, "left_semi")


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return _dealt(a, key).distinct().join(_dealt(b, key), key, "left_anti")


def shared_tokens(a: Column, b: Column) -> Column:
    """The words that two texts share, in order."""
    return F.array_sort(F.array_intersect(tokens(a), tokens(b)))


def row_count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def blocks_of(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Blocks whose document exists."""
    return blocks.join(documents.select("document_id"), "document_id", "left_semi")


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Blocks by document, without titles."""
    return row_count(blocks.where("block_type <> 'title'"), "document_id")


def latest_of(df: DataFrame, by: str, key: str) -> DataFrame:
    """The newest row of each group, by its key alone."""
    return df.groupBy(by).agg(F.max(key).alias(key))


def cases_by_document(cases: DataFrame) -> DataFrame:
    """Statements and cases of each document."""
    return cases.groupBy("document_id").agg(F.countDistinct("eiu_id").alias("statements"), F.count(F.lit(1)).alias("cases"))
