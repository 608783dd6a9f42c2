"""Toxicity scores: vectors of character n-grams, averaged over a few words, into a linear softmax.

Words are bags of their n-grams (with word edges), hashed into buckets that hold a vector each, so
an unseen misspelling shares the vectors of what it has in common with known words. The vectors
around each word are averaged and go into a softmax over two labels; a document scores as its most
toxic stretch. Vectors and softmax are trained jointly in numpy on a bounded sample of labelled rows
(``EACH`` of either label at most, none above ``LONGEST`` bytes). For scoring, vectors and softmax fold into a number a bucket.
Empty and null texts have no word and score 0; without labelled rows of both labels all score 0.
Repeated rows and equal keys are scored each on their own; only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewise import lower
from .common import ready, whole_text
from .labelled import fold, training_rows
from .quality import pieces

#: Labelled rows of either label that may be learnt from, and bytes of one, at most: what comes to the driver is bounded.
EACH, LONGEST = 1500, 50_000
FOLDS, HELD, THRESHOLD = 5, 0, 0.5
GRAMS, BUCKETS, SIZE, WORDS = (3, 4, 5, 6), 1 << 18, 8, 5
EDGE = 32
#: Letters, digits and everything outside ASCII make words; what else there is separates them.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """([(positions, buckets) for each n], word of each byte, first word of each text and their number).

    A position is that of the gram's second byte, which is always inside the word the gram belongs to.
    """
    n = len(at) - 1
    # each text gets an edge before and after it
    text = np.full(len(raw) + n + 1, EDGE, np.uint8)
    text[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(at))] = lower(raw)
    inside = IN_WORD[text]
    text = np.where(inside, text, EDGE)
    begins = inside & ~np.concatenate([[False], inside[:-1]])
    word = np.cumsum(begins) - 1
    first = np.concatenate([[0], np.cumsum(begins)])[at + np.arange(n + 1)]
    codes = (text.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    left = np.arange(len(text)) - np.maximum.accumulate(np.where(inside, 0, np.arange(len(text))))  # bytes of the word up to here
    found = []
    for k in GRAMS:
        h = np.zeros(max(len(text) - k + 1, 0), np.uint32)
        for j in range(k):
            h = (h ^ codes[j : j + len(h)]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        # bytes 1..k-2 are inside one word; an edge can stand only first or last
        mid = np.flatnonzero(left[k - 2 : k - 2 + len(h)] >= k - 2)
        mid = mid[inside[mid + 1]]
        found.append((mid + 1, (h[mid] ^ np.uint32(k * 0x85EBCA6B % 2**32)) % np.uint32(BUCKETS)))
    return found, word, first


def stretches(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of the stretch that ends at each word: WORDS words or as many as the text has."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.maximum(np.arange(first[-1]) - WORDS + 1, first[doc]), doc


class SubwordSoftmax:
    """``weight``: what each bucket adds to the log odds of label 1; ``bias``: the log odds without it."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], rounds: int = 5, batch: int = 16, rate: float = 0.5, seed: int = 7) -> SubwordSoftmax:
        """Adagrad on the stretch that scores highest in each text; in the first round on whole texts."""
        if len(set(labels)) < 2:
            return cls(np.zeros(BUCKETS), -np.inf)
        rng = np.random.default_rng(seed)
        vectors, out, bias = rng.normal(0, 0.1, (BUCKETS, SIZE)), rng.normal(0, 0.1, (SIZE, 2)), np.zeros(2)
        seen_v, seen_o, seen_b = np.full(BUCKETS, 1e-6), np.full((SIZE, 2), 1e-6), np.full(2, 1e-6)
        bags = [cls._bag(t) for t in texts]
        y = np.array(labels)
        for r in range(rounds):
            for some in np.array_split(order := rng.permutation(len(texts)), max(1, len(order) // batch)):
                use, owner = [], []
                scores = vectors @ (out[:, 1] - out[:, 0])
                for o, i in enumerate(some):
                    buckets, start = bags[i]
                    if len(start) < 2:
                        continue
                    lo, hi = 0, len(start) - 1
                    if r:
                        total = np.concatenate([[0], np.cumsum(scores[buckets])])[start]
                        first = np.maximum(np.arange(hi) - WORDS + 1, 0)
                        mean = (total[1:] - total[first]) / np.maximum(start[1:] - start[first], 1)
                        hi = int(mean.argmax()) + 1
                        lo = int(first[hi - 1])
                    b = buckets[start[lo] : start[hi]]
                    use.append(b)
                    owner.append(np.full(len(b), o))
                if not use:
                    continue
                b, o = np.concatenate(use), np.concatenate(owner)
                size = np.maximum(np.bincount(o, minlength=len(some)), 1)
                mean = np.column_stack([np.bincount(o, vectors[b, d], len(some)) for d in range(SIZE)]) / size[:, None]
                z = mean @ out + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                e = p
                e[np.arange(len(some)), y[some]] -= 1
                e /= len(some)
                e *= np.where(y[some] == 1, 1.0, 2.0)[:, None]  # a clean text taken for a toxic one costs twice
                back = (e @ out.T) / size[:, None]
                u, k = np.unique(b, return_inverse=True)
                grad = np.column_stack([np.bincount(k, back[o, d], len(u)) for d in range(SIZE)])
                seen_v[u] += (grad**2).mean(1)
                go, gb = mean.T @ e, e.sum(0)
                seen_o += go**2
                seen_b += gb**2
                vectors[u] -= rate * grad / np.sqrt(seen_v[u])[:, None]
                out -= rate * 0.2 * go / np.sqrt(seen_o)
                bias -= rate * 0.2 * gb / np.sqrt(seen_b)
        diff = out[:, 1] - out[:, 0]
        return cls(vectors @ diff, float(bias[1] - bias[0]))

    @staticmethod
    def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text by word, and where each word's begin."""
        raw = np.frombuffer(text.encode(), np.uint8)
        found, word, first = grams(raw, np.array([0, len(raw)]))
        w, b = np.concatenate([word[i] for i, _ in found]), np.concatenate([b for _, b in found])
        order = np.argsort(w, kind="stable")
        return b[order], np.concatenate([[0], np.cumsum(np.bincount(w, minlength=first[-1]))])

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each text's most toxic stretch."""
        found, word, first = grams(raw, at)
        n = int(first[-1])
        out = np.zeros(len(at) - 1)
        if not n:
            return out
        total, size = np.zeros(n), np.zeros(n)
        for i, b in found:
            total += np.bincount(word[i], self.weight[b], n)
            size += np.bincount(word[i], minlength=n)
        start, doc = stretches(first)
        total, size = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(size)])
        mean = (total[1:] - total[start]) / np.maximum(size[1:] - size[start], 1)
        has = np.flatnonzero(np.diff(first))
        best = np.maximum.reduceat(mean, first[has])
        out[has] = 1 / (1 + np.exp(-np.clip(best + self.bias, -700, 700)))
        return out


def train(docs: DataFrame, labels: DataFrame, each: int = EACH) -> SubwordSoftmax:
    rows = training_rows(docs, labels, "toxic", FOLDS, HELD, each, LONGEST).collect()  # 2 * each texts of LONGEST bytes at most
    rows.sort(key=lambda r: (r._key, r.label, r.text))
    return SubwordSoftmax.fit([r.text for r in rows], [r.label for r in rows])


def score_toxicity(docs: DataFrame, model: SubwordSoftmax, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every document."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast((model.weight.astype(np.float64), model.bias))  # a number for each of BUCKETS

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SubwordSoftmax(*shared.value)
        for b in batches:
            scores = [own.score(raw, at) for raw, at in pieces(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    scored = whole_text(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(go, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
