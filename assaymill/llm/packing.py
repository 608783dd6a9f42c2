"""Best-fit packing of tokenised documents into sequences: best-two-fit over the histogram of lengths.

Which document goes where depends on lengths alone, so the plan is made from the counts of each
length: a sequence is filled greedily, then its smallest piece gives way to two unpacked pieces that
fit the widened gap more tightly, and the same filling repeats while its lengths last. The plan has
a few rows for each length, whatever the number of documents. Null texts count as empty (only the
end id), only documents longer than a sequence are cut, repeated rows are packed each on its own,
an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, run_folder, stored, trim, whole_text
from .tokens import encoder, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, k long"


def fill(counts: dict[int, int], size: int) -> Counter:
    """Lengths of one sequence: greedy from the longest on, then two for the smallest where they fit better."""
    left, taken, gap = dict(counts), Counter(), size
    for n in sorted(left, reverse=True):
        if n <= gap:
            c = min(left[n], gap // n)
            taken[n] += c
            left[n] -= c
            gap -= c * n
    small = min(taken)
    if gap and taken.total() > 1:
        room, rest = gap + small, sorted(n for n, c in left.items() if c)
        best, lo, hi = small, 0, len(rest) - 1
        while lo <= hi:
            a, b = rest[lo], rest[hi]
            if a + b > room:
                hi -= 1
                continue
            if a + b > best and (lo < hi or left[a] > 1):
                best, pair = a + b, (a, b)
            lo += 1
        if best > small:
            taken[small] -= 1
            taken.update(pair)
    return +taken


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, dict[int, int]]]:
    """(first sequence, repeats, length to number in a sequence): all pieces in few sequences."""
    counts, out, first = {n: c for n, c in counts.items() if c}, [], 0
    while counts:
        taken = fill(counts, size)
        times = min(counts[n] // c for n, c in taken.items())
        out.append((first, times, dict(taken)))
        first += times
        for n, c in taken.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
    return out


def places(made: list[tuple[int, int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, copies in a sequence, first sequence, offset of the first copy)."""
    used: Counter = Counter()
    rows = []
    for first, times, taken in made:
        offset = 0
        for n in sorted(taken, reverse=True):
            c = taken[n]
            rows.append((n, used[n], used[n] + c * times, c, first, offset))
            used[n] += c * times
            offset += c * n
    return rows


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; of a longer document the first may be shorter."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return [(0, head)] * bool(head) + [(s, size) for s in range(head, n, size)]


def pieces(docs: DataFrame, vocab: str, end_id: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece; ``part`` and ``k`` number the pieces of one length within a task from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(vocab), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, keys = [], iter(batch.column(0).to_pylist())
            for ids, bounds in coder.encode(batch.column(1)):
                raw = ids.tobytes()
                for b, e, doc in zip(bounds[:-1].tolist(), bounds[1:].tolist(), keys, strict=False):  # bounds end first, so that no key is taken for nothing
                    for i, (s, n) in enumerate(pieces_of(e - b + 1, size)):
                        crc = zlib.crc32(raw[4 * (b + s) : 4 * min(b + s + n, e)])
                        rows.append((doc, i, s, n, crc if b + s + n <= e else zlib.crc32(end, crc), part, seen[n]))
                        seen[n] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
            del rows, columns
        trim()

    return whole_text(docs, key, text).select(F.col(key).cast("long").alias(key), text).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocab: str | None = None, end_id: int = 2, size: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece with its sequence and offset; sequences have no gaps and at most ``size`` tokens.

    Only the count of each length, ``size`` rows at most, passes the driver, and so bounds the broadcast plan.
    """
    with run_folder(docs.sparkSession, "packing"):
        return kept(_packed(docs, vocab, end_id, size, key, text), "packed")


def _packed(docs: DataFrame, vocab: str | None, end_id: int, size: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocab or vocabulary(), end_id, size, key, text), "pieces")
    by_task = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "base")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(places(plan(counts, size)), "length long, lo long, hi long, copies long, first long, at long")
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("k"))
    inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")) & (ranked["length"] == table["length"])
    step = F.col("rank") - F.col("lo")
    return ranked.join(F.broadcast(table), inside).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first") + F.floor(step / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + step % F.col("copies") * ranked["length"]).alias("offset"),
    )
