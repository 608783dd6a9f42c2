"""Texts as one array of UTF-8 bytes, so that numpy handles a whole batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a string column; null texts are empty. No byte is copied."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds; empty stretches give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of true values; a run ends at every bound."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.zeros(len(mask) + 1, bool)
    cut[bounds] = True
    begins = mask & (np.concatenate([[True], ~mask[:-1]]) | cut[:-1])
    ends = mask & (np.concatenate([~mask[1:], [True]]) | cut[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the output."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


#: Of rolling sums: an odd base, its inverse modulo 2**64, and a number for each byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
NUMBERS = mixed(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, kept for later calls."""
    if base not in _powers or len(_powers[base]) < n:
        made = np.full(n, base, np.uint64)
        made[:1] = 1
        _powers[base] = np.cumprod(made, dtype=np.uint64)
    return _powers[base][:n]


def rolling(raw: np.ndarray) -> np.ndarray:
    """Sums of byte numbers times powers of the base, so that any span's hash is a difference."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(NUMBERS[raw] * powers(BASE, len(raw)), dtype=np.uint64, out=total[1:])
    return total


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by content and length alone."""
    if not len(starts):
        return np.empty(0, np.uint64)
    total = rolling(raw) if total is None else total
    at = (total[ends] - total[starts]) * powers(INVERSE, len(raw) + 1)[starts]
    return mixed(at ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def row_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` neighbours of an array of hashes, by order and content."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    made = np.zeros(len(values) - n + 1, np.uint64)
    for j in range(n):
        made = made * np.uint64(BASE) + values[j : j + len(made)]
    return mixed(made)
