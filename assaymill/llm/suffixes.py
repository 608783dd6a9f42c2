"""A suffix array of chosen suffixes by two-stage sorting, in numpy.

Suffixes smaller than their successors are sorted directly; the others are induced from them by one scan of
the buckets of first bytes: in order, each suffix of a bucket puts its predecessor, if that is larger, into
the predecessor's bucket. Orders hold to a given depth, and so do the common prefixes of neighbours.
"""

from __future__ import annotations

import numpy as np


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one: by the next byte that differs."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=-1))
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def with_followers(chosen: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The chosen places and, after each, what it is induced from: all up to the next small suffix."""
    n = len(small)
    stop = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(chosen)
    np.add.at(edge, at, 1)
    np.add.at(edge, stop[at] + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


def sorted_directly(places: np.ndarray, words: np.ndarray, depth: int, equal: np.ndarray) -> np.ndarray:
    """``places`` in order of the ``depth`` bytes there, eight at a time, as long as neighbours tie.

    Ties whose members all have the same ``equal`` number, a hash of their ``depth`` bytes, need no more rounds.
    """
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    lo = 0
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1 if len(order) else np.empty(0, np.int64)
    active = np.arange(len(order))
    for at in range(8, depth, 8):
        if not len(active):
            break
        # groups of one member, or of members that are equal to full depth, are done
        g = group[active]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(start, len(g)))
        e = equal[order[active]]
        same = np.minimum.reduceat(e, start) == np.maximum.reduceat(e, start)
        active = active[np.repeat(~same & (size > 1), size)]
        if not len(active):
            break
        places = order[active]
        key = words[np.minimum(places + at, len(words) - 1)]
        g = group[active]
        by = np.lexsort((key, g))
        order[active] = places[by]
        key, g = key[by], g[by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])])
        group[active] = lo + len(order) + np.cumsum(new)
        lo += 2 * len(order)
    return order


def suffix_array(text: np.ndarray, chosen: np.ndarray, depth: int, equal: np.ndarray) -> np.ndarray:
    """The chosen places in the order of their suffixes, to ``depth`` bytes."""
    small = smaller_than_successor(text)
    needed = with_followers(chosen, small)
    direct = sorted_directly(np.flatnonzero(needed & small), eight_bytes(text), depth, equal)
    first = text[direct]
    begin = np.searchsorted(first, np.arange(257))
    larger = needed & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        # larger suffixes come before the small ones of a bucket; those in a run of one byte come in waves
        bucket, wave = [], np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        if c == text[-1] and len(text) and larger[-1]:
            wave = np.concatenate([[len(text) - 1], wave])
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[larger[before] & (text[before] == c)]
        bucket.append(direct[begin[c] : begin[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        if len(before):
            byte = text[before]
            by = np.argsort(byte, kind="stable")
            cut = np.flatnonzero(np.diff(byte[by])) + 1
            for part in np.split(before[by], cut):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(out)
    return order[chosen[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The length, ``depth`` at most, of the common prefix of each suffix with the one before it in ``order``."""
    out = np.zeros(len(order), np.int64)
    words, alive = eight_bytes(text), np.arange(1, len(order))
    for at in range(0, depth, 8):
        a, b = order[alive] + at, order[alive - 1] + at
        inside = np.minimum(len(text) - np.maximum(a, b), depth - at)
        x = words[np.minimum(a, len(words) - 1)] ^ words[np.minimum(b, len(words) - 1)]
        same = np.full(len(x), 8)
        for j in range(7, -1, -1):
            same[(x >> np.uint64(56 - 8 * j)) & np.uint64(255) != 0] = j
        out[alive] += np.clip(np.minimum(same, inside), 0, 8)
        alive = alive[(same == 8) & (inside > 8)]
        if not len(alive):
            break
    return out
