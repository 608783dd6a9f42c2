"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is WINDOW consecutive words of an item (an item of fewer words is one window) and the set
of its shingles. Shingles are ordered by how often the whole corpus holds them. As a hit needs all
of a window, its necessary prefix is its rarest shingle: documents and windows are joined on that one,
at the one place where the window would have to stand; places that the document's length or the
shingle's position rule out are dropped, and the rest are compared word by word, with the words around
the place.

Windows and places are tables: of the benchmark, tasks hold only bit tables of bounded size that
tell which shingles are worth a row, so it may be of any size. Texts are told apart by their digest,
and equal texts are compared once. Null texts have no words and items with a null id or text are ignored;
repeated items are one; repeated documents each get their own row; empty tables give no rows or no hits;
only keys and texts are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewise import joined, lower, row_hashes, runs, span_hashes
from .common import kept, run_folder, small_or_joined, stored, whole_text
from .filters import Filter, filter_of
from .quality import pieces

WINDOW, SHINGLE = 10, 5
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
PLACE = "doc_id long, key binary, n_words long, hash long, place long, first long, around string"


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends of words, first word of each text and their number)."""
    small = lower(raw)
    s, e = runs(IN_WORD[small], at)
    return small, s, e, np.searchsorted(s, at)


def batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def windows_of(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, window, size): the words of each window, joined by spaces."""
    schema = "item string, window string, size int"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = iter(b.column(0).to_pylist())
            for raw, at in pieces(b.column(1)):
                small, s, e, first = words_of(raw, at)
                whole, rows = small.tobytes(), []
                for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    name, words = next(names), [whole[x:y].decode() for x, y in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True)]
                    rows += {(name, " ".join(words[k : k + WINDOW]), min(WINDOW, len(words))) for k in range(max(1, len(words) - WINDOW + 1) if words else 0)}
                yield batch(schema, *(zip(*rows, strict=True) if rows else ([], [], [])))

    known = items.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).dropna().distinct()
    return stored(known.mapInArrow(go, schema).distinct(), "windows")


def shingles_of(windows: DataFrame) -> DataFrame:
    """(window, size, hash, place): the shingles of each window and where they stand in it."""
    schema = "window string, size int, hash long, place int"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = joined(b.column(0))
            small, s, e, first = words_of(raw, at)
            hashes, n = span_hashes(small, s, e), np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            for k in range(1, SHINGLE + 1):
                own = row_hashes(hashes, k)
                p = np.flatnonzero((np.minimum(n, SHINGLE)[owner[: len(own)]] == k) & (np.arange(len(own)) + k <= first[1:][owner[: len(own)]]))
                yield batch(schema, b.column(0).take(pa.array(owner[p])), n[owner[p]], own[p].view(np.int64), p - first[owner[p]])

    return stored(windows.select("window").distinct().mapInArrow(go, schema), "window-shingles")


def places(column: pa.Array, known: Filter, sizes: list[int]) -> Iterator[tuple]:
    """By stretch of texts: what ``words_of`` gives, and by shingle size the words at which hashes of the filter begin, with those."""
    for raw, at in pieces(column):
        small, s, e, first = words_of(raw, at)
        hashes, ends = span_hashes(small, s, e), np.repeat(first[1:], np.diff(first))
        hits = []
        for k in sizes:
            own = row_hashes(hashes, k)
            p = np.flatnonzero(np.arange(len(own)) + k <= ends[: len(own)])
            p = p[known.has(own[p])]
            hits.append((k, p, own[p]))
        yield small, s, e, first, hits


def counted(texts: DataFrame, known: Broadcast, sizes: list[int]) -> DataFrame:
    """(hash, n): how often the corpus holds the shingles of the filter, summed over each stretch before the shuffle."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, hits in places(b.column(0), Filter(known.value), sizes):
                u, n = np.unique(np.concatenate([h for _, _, h in hits]) if hits else np.empty(0, np.uint64), return_counts=True)
                yield batch("hash long, n long", u.view(np.int64), n)

    return texts.select("text").mapInArrow(go, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[int]]:
    """(window, size, hash, at) with each window's rarest shingle, ties to the smaller hash, and the sizes of shingles.

    A window with a shingle that no document holds is nowhere, so it is left out.
    """
    shingles = shingles_of(windows)
    sizes = [r.k for r in shingles.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().collect()]  # SHINGLE at most
    counts = counted(texts, filter_of(shingles.select("hash").distinct()), sizes)
    rarest = shingles.join(counts, "hash", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "place")).alias("p"))
    return stored(rarest.where("p.n > 0").select("window", "size", "p.hash", F.col("p.place").alias("at")), "prefixes"), sizes


def candidates(texts: DataFrame, known: Broadcast, sizes: list[int]) -> DataFrame:
    """A row per text with its number of words, and one per place of a prefix: its word, the first word around it and these words."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for small, s, e, first, hits in places(b.column(2), Filter(known.value), sizes):
                n, whole = len(first) - 1, small.tobytes()
                part = [b.column(i).slice(row, n) for i in (0, 1)]
                yield batch(PLACE, *part, np.diff(first), *[pa.nulls(n)] * 4)
                row += n
                for k, p, h in hits:
                    if len(p):
                        doc = np.searchsorted(first, p, "right") - 1
                        lo, hi = np.maximum(first[doc], p + k - WINDOW), np.minimum(first[doc + 1], p + WINDOW)
                        around = [" ".join([whole[x:y].decode() for x, y in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True)]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                        yield batch(PLACE, pa.nulls(len(p)), part[1].take(pa.array(doc)), pa.nulls(len(p)), h.view(np.int64), p - first[doc], lo - first[doc], around)

    return stored(texts.select("doc_id", "key", "text").mapInArrow(go, PLACE), "window-places")


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), 1, 16)


def occurrences(docs: DataFrame, items: DataFrame, item: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Documents as (doc_id, key, n_words), and what they hold as (key, start, size, item): the windows of items in each text."""
    texts = whole_text(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    windows = windows_of(items, item, text="text")
    wanted, sizes = prefixes(windows, texts)
    found = candidates(texts, filter_of(wanted.select("hash").distinct()), sizes)
    start = F.col("place") - F.col("at")
    met = found.where("hash IS NOT NULL").select("key", "hash", "place", "first", "around").join(small_or_joined(wanted), "hash").withColumn("start", start)
    words = F.slice(F.split("around", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("size"))
    same = met.where(F.col("start") >= F.col("first")).where(F.array_join(words, " ") == F.col("window"))
    hits = stored(same.select("key", "start", "size", "window").distinct().join(small_or_joined(windows.select("window", "item")), "window").select("key", "start", "size", "item"), "window-hits")
    return found.where("hash IS NULL").select("doc_id", "key", "n_words"), hits


def decontaminate(docs: DataFrame, items: DataFrame, item: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: words, hit words, items with occurring windows and their digest."""
    with run_folder(docs.sparkSession, "decontamination"):
        return kept(_measured(*occurrences(docs, items.select(F.col(item).alias("item_id"), F.col("text")), "item_id", key, text)), "hit-documents")


def _measured(rows: DataFrame, hits: DataFrame) -> DataFrame:
    # the widest window at each start, then a walk over starts in order
    widest = hits.groupBy("key", "start").agg(F.max("size").alias("size")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    walk = F.aggregate("spans", state, lambda t, x: F.struct(F.greatest(t["end"], x["end"]).alias("end"), (t["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], t["end"]))).alias("n")))
    named = hits.select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    of = widest.select("key", walk["n"].alias("n_hit")).join(named, "key")
    none = F.array().cast("array<string>")
    out = rows.join(small_or_joined(stored(of, "hit-texts")), "key", "left").withColumn("items", F.coalesce("items", none))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no window of any item."""
    plain = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with run_folder(docs.sparkSession, "decontamination"):
        _, hits = occurrences(plain, items.select(F.col(item).alias("item_id"), F.col("text")), "item_id", "doc_id", "text")
        gone = kept(hits.select(F.col("key").alias("_gone")).distinct(), "contaminated-texts")
    return docs.join(small_or_joined(gone), text_key(docs[text]) == gone["_gone"], "left_anti").select(docs.columns)
