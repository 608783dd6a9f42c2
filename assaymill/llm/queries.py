"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, dialogue, embeddings, html, jaccard, mixing, oracles, packing, pii, quality, substrings, token_output, toxicity, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end_id=2, size=1024)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_sets(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokenized(table(spark, sf_dir, "documents"), end_id=0)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damaged(rows), every=rows)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_toxicity": op2_toxicity,
        "op3_packing": op3_packing,
        "op4_quality": op4_quality,
        "op5_jaccard": op5_jaccard,
        "op6_decontamination": op6_decontamination,
        "op7_substrings": op7_substrings,
        "op8_embeddings": op8_embeddings,
        "op9_html": op9_html,
        "op10_token_ids": op10_token_ids,
        "op11_mixing": op11_mixing,
        "op12_dialogue": op12_dialogue,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator and runs over whole tables; the others are tested against brute force."""
    return dict(oracles.SQL)
