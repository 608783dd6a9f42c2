"""Token ids in binary files with Elias-Fano boundaries, written and read back by Spark tasks.

A file holds a run of documents in ascending key order: a header, the keys, the boundaries of the
documents as an Elias-Fano sequence with select samples, and the concatenated ids in the narrowest
width that the vocabulary allows. Files are bounded in ids, so a task holds one file at a time.
Null texts count as empty (only the end id), null keys come first, equal keys follow in input order,
repeated rows stay, empty tables write no file, and other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, ready, spread, stored, whole_text
from .tokens import encoder, vocabulary

MAGIC, HEADER = b"EFTOK001", "<8sQQQQQQ"
SAMPLE = 256
#: Ids and documents after which a task starts a new file; the texts that are encoded together may exceed them.
IDS_A_FILE, DOCS_A_FILE = 4_000_000, 200_000


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, a sampled select structure."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        ones = (values >> low_bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        pack = lambda b: np.packbits(b.astype(np.uint8).ravel(), bitorder="little")
        return cls(n, universe, low_bits, pack(bits), pack(unary), ones[::SAMPLE].astype("<u8"))

    def _lows(self, first: int, count: int) -> np.ndarray:
        at = first * self.low_bits
        raw = np.unpackbits(self.low[at // 8 : (at + count * self.low_bits + 7) // 8], bitorder="little")
        bits = raw[at % 8 : at % 8 + count * self.low_bits].reshape(count, self.low_bits).astype(np.int64)
        return bits @ (1 << np.arange(self.low_bits, dtype=np.int64)) if self.low_bits else np.zeros(count, np.int64)

    def select(self, i: int) -> int:
        """The ``i``-th value: from the nearest sample on, without decoding the rest."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little")[skip:])
            if left < len(ones):
                return int((byte * 8 + skip + ones[left] - i) << self.low_bits | self._lows(i, 1)[0])
            left, byte, skip = left - len(ones), byte + 64, 0

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((ones - np.arange(self.n)) << self.low_bits) | self._lows(0, self.n)

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


def pack_file(keys: list[int | None], bounds: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: ``bounds`` are the ends of the documents in ``ids``."""
    ef = EliasFano.encode(bounds)
    known = np.packbits(np.array([k is not None for k in keys], np.uint8))
    parts = [np.array([k or 0 for k in keys], "<i8"), known, ef.low, ef.high, ef.samples, ids]
    head = struct.pack(HEADER, MAGIC, len(keys), ef.universe, ef.low_bits, ef.low.nbytes, ef.high.nbytes, ids.itemsize)
    return head + b"".join(p.tobytes() for p in parts)


def unpack_file(raw: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    magic, n, universe, low_bits, low, high, width = struct.unpack_from(HEADER, raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEADER)

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, dtype, count, at)
        at += got.nbytes
        return got

    keys, known = take("<i8", n), np.unpackbits(take("u1", (n + 7) // 8), count=n)
    ef = EliasFano(n, universe, low_bits, take("u1", low), take("u1", high), take("<u8", (n + SAMPLE - 1) // SAMPLE))
    ids = np.frombuffer(raw, f"<u{width}", -1, at)
    return [int(k) if ok else None for k, ok in zip(keys, known, strict=True)], ef, ids


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, path: str, vocab: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts and write the files under ``path``; returns a row per file: its place in order, path and sizes.

    A retried task writes the same file again under a name of its own and then moves it into place.
    """
    spark = docs.sparkSession
    width = 2 if _ids_in(vocab) <= 1 << 16 and end_id < 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (store, root), part = encoder(vocab), open_store(path), TaskContext.get().partitionId()
        keys, ids, ends, total, made = [], [], [], 0, []

        def flush() -> None:
            nonlocal keys, ids, ends, total
            if keys:
                name = f"{root}/ids-{part:06d}-{len(made):06d}.ef"
                raw = pack_file(keys, np.concatenate(ends), np.concatenate(ids))
                store.create_dir(root, recursive=True)
                with store.open_output_stream(own := f"{name}.{uuid.uuid4().hex}") as out:
                    out.write(raw)
                store.move(own, name)
                made.append((part, len(made), f"{path}/{name.rsplit('/', 1)[1]}", len(keys), total))
                keys, ids, ends, total = [], [], [], 0

        for batch in batches:
            names = batch.column(0).to_pylist()
            for some, bounds in coder.encode(batch.column(1)):
                n = len(bounds) - 1
                keys += names[:n]
                names = names[n:]
                ids.append(np.insert(some, bounds[1:], end_id).astype(f"<u{width}"))
                ends.append(total + bounds[1:] + np.arange(1, n + 1))
                total += len(ids[-1])
                if total >= IDS_A_FILE or len(keys) >= DOCS_A_FILE:
                    flush()
        flush()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "file", "path", "n_docs", "n_ids"), x, strict=True)) for x in made],
            schema=pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    rows = whole_text(docs, key, text).select(F.col(key).cast("long").alias(key), text).withColumn("_row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(spread(spark), key, "_row").sortWithinPartitions(key, "_row").select(key, text)
    return stored(ordered.mapInArrow(write, "part long, file long, path string, n_docs long, n_ids long"), "token-files")


def _ids_in(vocab: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab).get_vocab_size()


def read_tokens(files: DataFrame) -> DataFrame:
    """Read the files that ``write_tokens`` lists: a row per document with its place in the whole id sequence.

    Only a total for each writing task passes the driver.
    """
    spark: SparkSession = files.sparkSession
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    at, base = 0, []
    for r in totals:
        base.append((r.part, at))
        at += r.n
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        files.withColumn("_inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .join(F.broadcast(spark.createDataFrame(base, "part long, base long")), "part")  # a row for each task
        .select("path", (F.col("base") + F.col("_inside")).alias("start"))
        .repartition(spread(spark), "path")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = open_store(path)
                with store.open_input_stream(name) as f:
                    keys, ef, ids = unpack_file(f.read())
                ends = ef.values()
                starts = np.concatenate([[0], ends[:-1]])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [keys, starts + start, ends - starts, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """Write all documents' ids to a fresh folder of the shared store and read them back."""
    ready(docs.sparkSession)
    return read_tokens(write_tokens(docs, fresh_path(docs.sparkSession, "token-ids"), vocab or vocabulary(), end_id))
