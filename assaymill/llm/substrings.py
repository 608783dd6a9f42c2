"""Exact removal of byte strings that repeat anywhere in a corpus, by suffix sorting of the few places that can repeat.

Every SPAN-byte string chooses an anchor: the GRAM-byte string inside it with the smallest hash. Equal strings
choose equal anchors at equal places, so only strings of one anchor need comparing, and most anchors of a
corpus occur once. An anchor's stretch holds all strings that chose it. Three passes over the texts:
count the anchors; compare the stretches of repeated anchors by digest (stretches that occur again are
covered whole); and sort one of each kind of the rest, the groups with stretches that occur once among others,
by a two-stage suffix array, where neighbours with a common prefix of SPAN bytes are repeats. Groups of more
than HOT kinds are compared string by string by 128-bit digests instead, so that no task holds a group. Filters between the passes are bit tables of bounded size: a false hit costs a comparison.

Null and empty texts have nothing to remove; texts shorter than SPAN keep all bytes; copies of a text are
one class and, from SPAN bytes on, wholly removed; periodic texts repeat within themselves; repeated rows
count as copies; null keys are allowed; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewise import INVERSE, NUMBERS, mixed, powers, rolling
from .common import kept, run_folder, small_or_joined, spread, stored, whole_text
from .filters import OTHER, Filter, filter_of
from .quality import pieces
from .suffixes import common_prefixes, suffix_array

SPAN, GRAM = 200, 50
WIDTH = SPAN - GRAM + 1
#: Stretches of a group that are sorted together, bytes that are sorted at once, and ids that are broadcast at most.
HOT, AT_ONCE, IDS_AT_ONCE = 4096, 1_000_000, 2_000_000
PLACE = np.uint64((1 << 26) - 1)
EMPTY = hashlib.sha256(b"").hexdigest()


def stretches(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first and last start, anchor's hash, digest) of each run of neighbouring strings with one anchor."""
    none = np.empty(0, np.int64)
    if len(raw) < SPAN:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    n, total = len(raw), rolling(raw)
    h = mixed((total[GRAM:] - total[:-GRAM]) * powers(INVERSE, n + 1)[: n - GRAM + 1])
    # smallest hash of each WIDTH neighbours, the first of equal ones: minima up to and from block edges
    v = (h & ~PLACE) | (np.arange(len(h), dtype=np.uint64) & PLACE)
    x = np.concatenate([v, np.full(-len(v) % WIDTH, 2**64 - 1, np.uint64)]).reshape(-1, WIDTH)
    before = np.minimum.accumulate(x, 1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[: n - SPAN + 1], before[WIDTH - 1 : len(v)])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(np.arange(len(least)) + SPAN <= at[doc[: len(least)] + 1])
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    low = (least[starts] & PLACE).astype(np.int64)
    anchor = starts + ((low - starts) & int(PLACE))  # places are kept modulo the mask
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    lo, hi, anchor = starts[first], starts[np.append(first[1:] - 1, len(starts) - 1)], anchor[first]
    text = (total[hi + SPAN] - total[lo]) * powers(INVERSE, n + 1)[lo]
    shape = mixed((hi - lo).astype(np.uint64) << np.uint64(32) | (anchor - lo).astype(np.uint64))
    return doc[lo], lo, hi, h[anchor], mixed(text ^ shape)


def anchors(texts: DataFrame) -> DataFrame:
    """(anchor, n) of what occurs again, summed over each batch before the shuffle."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stretches(raw, at)[3] for raw, at in pieces(b.column(1))]
            u, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.minimum(n, 2))], names=["anchor", "n"])

    return texts.mapInArrow(go, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def occurrences(texts: DataFrame, repeated: Broadcast) -> DataFrame:
    """(key, lo, hi, anchor, digest, place) of the stretches of anchors in the filter; the place is a hash of key and start."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(repeated.value)
        for b in batches:
            row = 0
            for raw, at in pieces(b.column(1)):
                doc, lo, hi, anchor, digest = stretches(raw, at)
                on = np.flatnonzero(known.has(anchor))
                base = at[doc[on]]
                columns = [b.column(0).take(pa.array(doc[on] + row)), *map(pa.array, (lo[on] - base, hi[on] - base, anchor[on].view(np.int64), digest[on].view(np.int64)))]
                spot = place(b.column(0), doc[on] + row, lo[on] - base)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spot.view(np.int64))], names=["key", "lo", "hi", "anchor", "digest", "place"])
                row += len(at) - 1

    return stored(texts.mapInArrow(go, "key binary, lo long, hi long, anchor long, digest long, place long"), "stretches")


def place(keys: pa.Array, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the text's key, 16 bytes, and a start in it."""
    _, offsets, data = keys.buffers()
    at = np.frombuffer(offsets, np.int32, len(keys) + 1, 4 * keys.offset)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if len(keys) else np.empty(0, np.uint8)
    first = np.ascontiguousarray(raw.reshape(-1, 16)[:, :8]).view("<u8").ravel()
    return mixed(first[rows] ^ (starts.astype(np.uint64) * np.uint64(OTHER)))


def sorted_repeats(texts: DataFrame, chosen: Broadcast, groups: DataFrame) -> DataFrame:
    """(key, lo, hi): starts of strings that occur again, by suffix sorting of one of each kind of the groups' stretches.

    ``chosen`` is a filter of the places of these; what it lets through besides goes where it isn't of the groups.
    """
    spark = texts.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(chosen.value)
        for b in batches:
            row = 0
            for raw, at in pieces(b.column(1)):
                doc, lo, hi, anchor, digest = stretches(raw, at)
                on = np.flatnonzero(known.has(place(b.column(0), doc + row, lo - at[doc]))) if len(doc) else doc
                base, whole = at[doc[on]], raw.tobytes()
                cuts = [whole[i : j + SPAN] for i, j in zip(lo[on].tolist(), hi[on].tolist(), strict=True)]
                columns = [b.column(0).take(pa.array(doc[on] + row)), *map(pa.array, (lo[on] - base, hi[on] - base, anchor[on].view(np.int64), digest[on].view(np.int64))), pa.array(cuts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "lo", "hi", "anchor", "digest", "bytes"])
                row += len(at) - 1

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for b in batches:
            for key, lo, hi, anchor, digest, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= AT_ONCE and anchor != last[0]:
                    yield repeats(rows)
                    rows, size = [], 0
                if (anchor, digest) != last:
                    rows.append((key, lo, hi, raw))
                    size += len(raw)
                last = anchor, digest
        if rows:
            yield repeats(rows)

    schema = "key binary, lo long, hi long, anchor long, digest long, bytes binary"
    exact = texts.mapInArrow(cut, schema).join(small_or_joined(groups), "anchor", "left_semi")
    dealt = exact.repartition(spread(spark), "anchor").sortWithinPartitions("anchor", "digest").select([x.split()[0] for x in schema.split(", ")])
    return dealt.mapInArrow(sort, "key binary, lo long, hi long")


def repeats(rows: list[tuple[bytes, int, int, bytes]]) -> pa.RecordBatch:
    """(key, lo, hi) of the starts whose strings occur again in the rows' stretches."""
    sizes = np.array([len(r[3]) + 1 for r in rows])
    text = np.frombuffer(b"\0".join(r[3] for r in rows) + b"\0", np.uint8)
    begin = np.cumsum(sizes) - sizes
    edge = np.zeros(len(text) + 1, np.int64)
    edge[begin] += 1
    edge[begin + sizes - SPAN] -= 1
    chosen = np.cumsum(edge)[:-1] > 0
    total = rolling(np.concatenate([text, np.zeros(SPAN, np.uint8)]))
    equal = mixed((total[SPAN : SPAN + len(text)] - total[: len(text)]) * powers(INVERSE, len(text)))
    order = suffix_array(text, chosen, SPAN, equal)
    again = np.flatnonzero(common_prefixes(text, order, SPAN) >= SPAN)
    hit = np.zeros(len(text), bool)
    hit[order[again]] = hit[order[again - 1]] = True
    s = np.flatnonzero(hit)
    row = np.searchsorted(begin, s, "right") - 1
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] != s[:-1] + 1)]) if len(s) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(s) - 1) if len(s) else first
    own, shift = row[first], np.array([r[1] for r in rows]) - begin
    columns = [pa.array([rows[i][0] for i in own.tolist()], pa.binary()), pa.array(s[first] + shift[own]), pa.array(s[last] + shift[own])]
    return pa.RecordBatch.from_arrays(columns, names=["key", "lo", "hi"])


def hot_repeats(texts: DataFrame, groups: Broadcast) -> DataFrame:
    """The same for groups too large to sort together: digests of the strings, one row of equal ones a batch, counted."""
    salted = NUMBERS[::-1].copy()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(groups.value)
        for b in batches:
            keys, starts, firsts, seconds, counts, row = [], [], [], [], [], 0
            for raw, at in pieces(b.column(1)):
                doc, lo, hi, anchor, _ = stretches(raw, at)
                on = np.flatnonzero(known.has(anchor))
                if len(on):
                    size = hi[on] - lo[on] + 1
                    s = np.repeat(lo[on] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    d = np.repeat(doc[on], size)
                    one = rolling(raw)
                    two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted[raw] * powers(OTHER, len(raw)), dtype=np.uint64)])
                    inverse = pow(OTHER, -1, 1 << 64)
                    starts.append(s - at[d])
                    firsts.append(mixed((one[s + SPAN] - one[s]) * powers(INVERSE, len(raw) + 1)[s]))
                    seconds.append(mixed((two[s + SPAN] - two[s]) * powers(inverse, len(raw) + 1)[s]))
                    keys.append(d + row)
                row += len(at) - 1
            if not starts:
                continue
            k, s, x, y = map(np.concatenate, (keys, starts, firsts, seconds))
            by = np.lexsort((y, x))
            new = np.concatenate([[True], (x[by][1:] != x[by][:-1]) | (y[by][1:] != y[by][:-1])])
            n = np.diff(np.append(np.flatnonzero(new), len(by)))
            many = np.repeat(n > 1, n)
            # repeats within the batch are known as such, as runs; one of them goes on to meet those of other batches
            known_now = np.sort(by[many])
            row_of, at_of = k[known_now], s[known_now]
            edge = np.concatenate([[True], (row_of[1:] != row_of[:-1]) | (at_of[1:] != at_of[:-1] + 1)]) if len(at_of) else np.empty(0, bool)
            first = np.flatnonzero(edge)
            last = np.append(first[1:] - 1, len(at_of) - 1) if len(first) else first
            one_of = by[new]
            none = np.zeros(len(first), np.int64)
            columns = [
                b.column(0).take(pa.array(np.concatenate([row_of[first], k[one_of]]))), pa.array(np.concatenate([at_of[first], s[one_of]])), pa.array(np.concatenate([at_of[last], s[one_of]])),
                pa.array(np.concatenate([none, x[one_of].view(np.int64)])), pa.array(np.concatenate([none, y[one_of].view(np.int64)])), pa.array(np.concatenate([none == 1, n > 0])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lo", "hi", "x", "y", "meets"])

    found = stored(texts.mapInArrow(go, "key binary, lo long, hi long, x long, y long, meets boolean"), "hot-strings")
    met = found.where("meets")
    again = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y")
    return found.where("NOT meets").select("key", "lo", "hi").unionByName(met.join(again, ["x", "y"], "left_semi").select("key", "lo", "hi"))


def among(df: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """A semi or anti join with a list of ids, broadcast only up to a bound."""
    ids = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
    return df.join(F.broadcast(ids) if ids.count() <= IDS_AT_ONCE else ids, column, how)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    with run_folder(docs.sparkSession, "substrings"):
        return kept(_stripped(docs, key, text), "stripped")


def _stripped(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = whole_text(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("sha", F.sha2("text", 256))
    short = F.substring(F.unhex("sha"), 1, 16)
    listed = stored(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha", short.alias("key")), "texts")
    classes = listed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    copied = stored(classes.where("copies > 1"), "copied-texts")
    # of equal texts one is enough; a mark that other rows have as well drops none
    mark, copy = F.xxhash64("doc_id", "key").alias("mark"), F.col("copies").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first"))
    copies = listed.join(copied, "key", "left").select(mark, copy.alias("copy")).groupBy("mark").agg(F.bool_and("copy").alias("copy")).where("copy")
    keyed = rows.select("doc_id", short.alias("key"), "text")
    texts = among(keyed.where(F.octet_length("text") >= SPAN).select("key", "text", mark), "mark", stored(copies.select("mark"), "copies"), "left_anti").select("key", "text")

    found = occurrences(texts, filter_of(stored(anchors(texts), "anchors")))
    digests = stored(found.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")), "digests")
    whole = found.join(digests.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("key", "lo", "hi")
    groups = stored(digests.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1"), "groups")
    cold, hot = (groups.where(c).select("anchor") for c in (f"kinds <= {HOT}", f"kinds > {HOT}"))
    one_of_each = digests.join(small_or_joined(cold), "anchor", "left_semi").select("place")
    repeated = whole.unionByName(sorted_repeats(texts, filter_of(one_of_each), cold))
    if not hot.isEmpty():
        repeated = repeated.unionByName(hot_repeats(texts, filter_of(hot)))
    spans = stored(repeated.join(copied.select("key"), "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("starts")), "repeats")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for k, t, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, kept, end, removed, runs = t.encode(), [], 0, 0, 0
                for x in starts:
                    lo, hi = x["lo"], x["hi"] + SPAN
                    if lo > end or not runs:
                        kept.append(raw[end:lo])
                        runs += 1
                        removed += hi - lo
                    else:
                        removed += max(0, hi - end)
                    end = max(end, hi)
                kept.append(raw[end:])
                made.append((k, removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
            columns = list(zip(*made, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "removed", "runs", "kept"])

    touched = F.xxhash64("key").alias("mark")  # what else has the mark of such a text goes with the join on keys
    some = among(keyed.select("key", "text", touched), "mark", spans.select(touched), "left_semi").join(spans, "key")
    stripped = some.select("key", "text", "starts").mapInArrow(strip, "key binary, removed long, runs long, kept string").dropDuplicates(["key"])
    out = listed.join(copied.select("key", "copies"), "key", "left").join(stripped, "key", "left")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= SPAN)
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
