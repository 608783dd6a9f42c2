"""Quality scores: histogram gradient-boosted trees over statistics of whole documents.

Trees are trained on a bounded sample of labelled rows (``EACH`` of either label at most) and
flattened into arrays, so that a batch of documents goes down all trees by numpy indexing.
Empty and null texts have all counts 0 and get the score that the trees give for that; with no
labelled rows of both labels every score is the share of label 1 (0.5 without any). Repeated rows
and equal keys are scored each on their own; only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewise import joined, lower, runs, span_hashes, sums
from .common import ready, trim, whole_text
from .labelled import fold, training_rows
from .tokens import release

#: Labelled rows of either label that the trees may learn from, at most.
EACH = 6000
FOLDS, HELD, THRESHOLD = 4, 2, 0.7
#: Sign classes whose share of all bytes is a feature.
SIGNS = ("#", "%", "&", "*", "$", "|", "!", ".", ",", "?", "-", "/", ":;", "()[]{}<>", "'\"", "@_=+^~`\\")
#: Longest stretch whose bytes are looked at together.
AT_ONCE = 250_000
#: Rows that are scored and given back together.
ROWS = 1000


def distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By owner: the number of distinct hashes and the largest number of equal ones."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    size, most = np.diff(np.append(first, len(h))), np.zeros(n)
    np.maximum.at(most, o[first], size)
    return np.bincount(o[first], minlength=n).astype(float), most


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of features per text: lengths, shares of kinds of bytes, words, repeated words and lines."""
    n, size = len(at) - 1, np.maximum(np.diff(at), 1).astype(float)
    kind = np.zeros(256, np.int64)
    upper, low, digit, high, blank, feed = 1, 2, 3, 4, 5, 6
    kind[65:91], kind[97:123], kind[48:58], kind[128:], kind[[32, 9, 13]], kind[10] = upper, low, digit, high, blank, feed
    for i, signs in enumerate(SIGNS, 7):
        kind[[ord(c) for c in signs]] = i
    kinds = 7 + len(SIGNS)
    doc = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(doc * kinds + kind[raw], minlength=n * kinds).reshape(n, kinds).astype(float)
    small = lower(raw)
    s, e = runs((kind[raw] != blank) & (kind[raw] != feed), at)
    word_doc = doc[s] if len(s) else np.empty(0, np.int64)
    words = np.bincount(word_doc, minlength=n).astype(float)
    per = np.maximum(words, 1)
    length = (e - s).astype(float)
    mean = np.bincount(word_doc, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(word_doc, length**2, n) / per - mean**2, 0))
    kinds_of_words, top_word = distinct(span_hashes(small, s, e), word_doc, n)
    letters = np.bincount(word_doc, (kind[raw[e - 1]] <= high) & (kind[raw[e - 1]] > 0), n) / per if len(s) else np.zeros(n)
    capital = np.bincount(word_doc, kind[raw[s]] == upper, n) / per if len(s) else np.zeros(n)
    short = np.bincount(word_doc, length <= 3, n) / per
    ls, le = runs(kind[raw] != feed, at)
    line_doc = doc[ls] if len(ls) else np.empty(0, np.int64)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    kinds_of_lines, top_line = distinct(span_hashes(small, ls, le), line_doc, n)
    per_line = np.maximum(lines, 1)
    return np.column_stack([
        np.log1p(np.diff(at)), np.log1p(words), counts / size[:, None], mean, spread, kinds_of_words / per, top_word / per,
        letters, capital, short, np.log1p(lines), kinds_of_lines / per_line, top_line / per_line, size / per_line,
        counts[:, upper] / np.maximum(counts[:, upper] + counts[:, low], 1),
    ])


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts of a column in stretches of about AT_ONCE bytes, each text whole."""
    raw, at = joined(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + AT_ONCE, "right")) - 1)
        yield raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def featured(column: pa.Array) -> np.ndarray:
    made = [statistics(raw, at) for raw, at in pieces(column)]
    return np.concatenate(made) if made else np.empty((0, statistics(np.empty(0, np.uint8), np.zeros(2, np.int64)).shape[1]))


class Boosted:
    """Trees as arrays: inner nodes hold a feature and a threshold, node i's children are 2i+1 and 2i+2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Boosted:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        base, inner = float(np.log(share / (1 - share))), 2**depth - 1
        if len(np.unique(y)) < 2:
            return cls(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        width, features = bins, x.shape[1]
        feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
        f = np.full(len(y), base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
            for level in range(depth):
                first, nodes = 2**level - 1, 2**level
                local = node - first
                hist = np.zeros((3, nodes, features, width))
                for j in range(features):
                    k = local * width + binned[:, j]
                    for i, w in enumerate((g, h, None)):
                        hist[i, :, j] = np.bincount(k, w, nodes * width).reshape(nodes, width)
                left = hist.cumsum(-1)
                right = left[..., -1:] - left
                gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - (left[0] + right[0])[..., :1] ** 2 / ((left[1] + right[1])[..., :1] + l2)
                gain[(left[2] < least) | (right[2] < least)] = -1
                for j, e in enumerate(edges):
                    gain[:, j, len(e) :] = -1
                best = gain.reshape(nodes, -1).argmax(1)
                for q, b in enumerate(best):
                    j, cut = divmod(int(b), width)
                    if gain[q, j, cut] > 1e-6:
                        feature[t, first + q], threshold[t, first + q] = j, edges[j][cut]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
            leaf = node - inner
            value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
            f += value[t, leaf]
        return cls(base, feature, threshold, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        f, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            f += self.value[t, node - inner]
        return 1 / (1 + np.exp(-f))


def train(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Boosted:
    """Trees from the statistics of the sampled rows; only those numbers come to the driver."""
    ready(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            x = featured(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["_key", "label", "x"])

    rows = training_rows(docs, labels, "quality", FOLDS, HELD, each).mapInArrow(measure, "_key long, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r._key, r.label, r.x))
    return Boosted.fit(np.array([r.x for r in rows]), np.array([r.label for r in rows], float))


def score_quality(docs: DataFrame, model: Boosted, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every document."""
    ready(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(featured(b.column(1))), pa.float64())], names=["doc_id", "score"])

    scored = whole_text(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(go, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores THRESHOLD or more.

    Null texts are scored as empty ones and stay null where they are kept; null and repeated keys are of no matter,
    and an empty table gives no rows.
    """
    ready(docs.sparkSession)
    at = docs.columns.index(text)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                yield b.filter(pa.array(model.score(featured(b.column(at))) >= THRESHOLD))
        trim()

    return docs.mapInArrow(go, docs.schema)
