"""Bit tables of bounded size that tell which hashes a column may hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .bytewise import mixed
from .common import spread

#: Bits of a filter: so many for each entry, up to a bound.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Bits that one task sets at a time.
CHUNK = 1 << 20
OTHER = 0xD1B54A32D192ED03


class Filter:
    """A table of bits with two hashes an entry: a false hit is possible, a missed entry isn't."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(hashes ^ np.uint64(OTHER))
        return (h % np.uint64(size)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes, 8 * len(self.bits))
        get = lambda i: (self.bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1
        return (get(a) & get(b)).astype(bool)


def filter_of(hashes: DataFrame) -> Broadcast:
    """A filter of a column of hashes; each task sets the bits of some chunks, and the whole is MOST_BITS at most."""
    count, name, spark = hashes.count(), hashes.columns[0], hashes.sparkSession
    size = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * count).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(Filter.places(b.column(0).to_numpy().view(np.uint64), size)))
            yield pa.RecordBatch.from_arrays([pa.array(at // CHUNK), pa.array(at % CHUNK)], names=["chunk", "bit"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, bit = (c.to_numpy() for c in b.columns)
            for k in np.unique(chunk).tolist():
                made.setdefault(k, np.zeros(min(CHUNK, size), bool))[bit[chunk == k]] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in made.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array(packed, pa.binary())], names=["chunk", "bits"])

    marked = hashes.select(name).mapInArrow(place, "chunk long, bit long").repartition(min(spread(spark), -(-size // CHUNK)), "chunk")
    bits = np.zeros(size // 8, np.uint8)
    for r in marked.mapInArrow(build, "chunk long, bits binary").collect():  # size / 8 bytes in all
        at = r.chunk * CHUNK // 8
        bits[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(bits)
