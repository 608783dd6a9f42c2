"""A corpus from documents: drop poor texts, near duplicates and benchmark leaks, redact personal data, pack.

Each stage calls one operator of ``assaymill.llm`` on all that the stage before kept; all but the last return
the columns of ``documents``, and the last one the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaymill.llm import decontamination, jaccard, packing, pii, quality
from assaymill.llm.common import run_folder, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows of all documents."""
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return jaccard.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; lengths are counted anew."""
    return pii.redact_pii(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack(docs, end_id=2, size=1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", no_benchmark),
    ("personal_data", no_personal_data),
    ("packing", packed),
]

#: Trees, packing and tokenisers have no SQL; ``run`` is tested against plain Python versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again; only the last one's rows stay there."""
    docs = table(spark, sf_dir, "documents")
    with run_folder(spark, "pipeline"):
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)  # written as a result, so it needs none of the stages' tables
