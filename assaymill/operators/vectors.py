"""Ranking of statements and blocks by vectors or words, for given queries."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.text import tokens
from assaymill.operators.neighbours import nearest


def indexed(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Only vectors of the index's length."""
    return vectors.where(F.size(vector) == dim)


def without_documents(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """An index without the vectors of some documents."""
    return vectors.join(documents.select("document_id"), "document_id", "left_anti")


def top_k(queries: DataFrame, items: DataFrame, k: int = 5, least: float | None = None, itself: bool = False, digits: int | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the best items of each query by inner product, ties to the smaller id.

    ``queries``: (query_id, vector); ``items``: (item_id, vector), any number of both, filtered beforehand where only some count.
    """
    best = nearest(queries, items, k, least=least, itself=itself)
    return best if digits is None else best.withColumn("score", F.round("score", digits))


def best_reuse(queries: DataFrame, items: DataFrame, threshold: float = S.REUSE_COSINE) -> DataFrame:
    """The most similar earlier item of each query at or above the threshold; ties to the later id."""
    return nearest(queries, items, 1, least=threshold, later=True).select("query_id", "item_id", F.round("score", 4).alias("similarity"))


def scored_pairs(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """Adds ``score`` to rows with ``question`` and ``text``: a model of pairs, given a batch at a time."""

    @F.pandas_udf("double")
    def score(question: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(scorer(question.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

    return pairs.withColumn("score", score("question", "text"))


def reranked(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int | None = None) -> DataFrame:
    """Texts of each query by the score of a model of pairs, best first with ``rank``, cut after ``k`` where it is given."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id")))
    out = scored_pairs(pairs, scorer).withColumn("rank", rank)
    return out if k is None else out.where(F.col("rank") <= k)


def encoded(rows: DataFrame, encoder: Callable[[list[str]], list[list[float]]] | None, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds ``embedding``: the unit vector that a model gives each text, after a prefix that queries may have.

    Without a model, and for texts that are null, vectors are null; a zero vector stays as it is.
    """
    if encoder is None:
        return rows.withColumn("embedding", F.lit(None).cast("array<float>"))

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        some = texts[texts.notna()]
        if not len(some):
            return pd.Series([None] * len(texts), texts.index, dtype=object)
        made = np.array(encoder([prefix + t for t in some]), float).reshape(len(some), -1)
        norm = np.sqrt((made * made).sum(1, keepdims=True))
        return pd.Series([*(made / np.where(norm == 0, 1, norm)).astype("float32")], some.index, dtype=object).reindex(texts.index)

    return rows.withColumn("embedding", encode(text))


def lexical(question: str, blocks: DataFrame) -> DataFrame:
    """(block_id, score): cosine of word counts and a tenth for each word shared; blocks without a shared word score 0.

    A block's counts are taken inside its row, so nothing is shuffled.
    """
    found = blocks.sparkSession.range(1).select(tokens(F.lit(question))).first()[0]
    asked = {t: found.count(t) for t in found}
    words, start = F.col("_words"), F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("squares"))

    def count(a: Column, w: Column) -> Column:  # (n + 1)^2 is n^2 + 2 n + 1
        again = (a["last"] == w) & (a["run"] > 0)
        run = F.when(again, a["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(w.alias("last"), (run + 1).alias("run"), (a["squares"] + 2 * run + 1).alias("squares"))

    norm = F.sqrt(F.aggregate(F.array_sort(words), start, count)["squares"].cast("double"))
    times = {t: F.size(F.filter(words, partial(operator.eq, F.lit(t)))) for t in asked}
    shared = sum((n * asked[t] for t, n in times.items()), F.lit(0))
    overlap = sum(((n > 0).cast("int") for n in times.values()), F.lit(0))
    q_norm = float(sum(n * n for n in asked.values())) ** 0.5
    score = F.coalesce(F.try_divide(shared.cast("double"), norm * q_norm), F.lit(0.0)) + overlap * 0.1
    out = blocks.withColumn("_words", tokens(F.coalesce("block_text", F.lit(""))))
    return out.select("block_id", F.substring("block_text", 1, 200).alias("source_excerpt"), F.round(score, 4).alias("score"))
