"""Labelled rows for training: a bounded, repeatable sample of the rows that may be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; -1 for null keys, which are in none."""
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(-1))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, each: int, longest: int | None = None) -> DataFrame:
    """(text, label) of at most ``each`` rows of either label, those with the smallest hashes of their keys.

    Rows of the held-out fold and rows without a label are never taken, nor, where ``longest`` is given, are texts of
    more bytes. The sample is bounded, so it can be broadcast.
    """
    known = labels.select(F.col("doc_id").alias("_key"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("_key").isNotNull() & (fold(F.col("_key"), folds) != held)
    )
    some = [known.where(F.col("label") == x).orderBy(F.xxhash64("_key"), "_key").limit(each) for x in (0, 1)]
    sample = some[0].unionByName(some[1])
    texts = docs.select(F.col("doc_id").alias("_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts if longest is None else texts.where(F.octet_length("text") <= longest)
    return texts.join(F.broadcast(sample), "_key").select("_key", "text", "label")
