"""Token ids of whole texts by the tokenizers library, each distinct word encoded once a worker.

A byte-level BPE merges inside the pieces that its pattern splits off, and that pattern always
splits before a space and around a line feed that stand between two visible characters, and where
a run of letters, digits or other signs ends (but after an apostrophe, and where a sign meets one).
So a batch of texts is cut at those places as one array of bytes, equal units are found by Arrow,
and only units that a worker hasn't met are encoded. Only ASCII and Latin letters are split so; other
characters, blanks in a row or at an end and rarer white space stay inside a unit, which the library
then splits itself. Texts with a special token's string, and vocabularies that split by another
pattern, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bytewise import joined
from .common import trim

#: Units of a generation that a worker keeps, beyond which it forgets those not asked for since the one before; and the longest one that is kept.
UNIT_LIMIT, UNIT_BYTES = 150_000, 200
#: Bytes of texts that are cut together, and units that are joined together.
TEXT_BYTES, UNITS_AT_ONCE = 600_000, 200_000
OTHER, LETTER, DIGIT, SIGN, APOSTROPHE, SPACE, FEED = range(7)
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = SIGN
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[48:58] = DIGIT
KINDS[[39, 32, 10]] = APOSTROPHE, SPACE, FEED
#: Whether the pattern always splits between two kinds: [first, second].
ENDS = np.zeros((8, 8), bool)
ENDS[LETTER, [DIGIT, SIGN, APOSTROPHE]] = ENDS[DIGIT, [LETTER, SIGN, APOSTROPHE]] = ENDS[SIGN, [LETTER, DIGIT]] = True
ENDS = ENDS.ravel()
#: A unit that is one piece of the pattern: a leading space or none, then letters, digits or signs.
PIECE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~×÷]+)")
PATTERN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def alphabet() -> dict[int, int]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where units begin: at each text that isn't empty and where the pattern always splits."""
    kind = KINDS[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))  # of two-byte characters up to U+027F
    first, second = raw[lead], raw[lead + 1]
    latin = np.where((first == 0xC3) & ((second == 0x97) | (second == 0xB7)), SIGN, LETTER)  # × and ÷
    latin[(first == 0xC9) & (second > 0x8F)] = OTHER
    kind[lead] = kind[lead + 1] = latin
    begins = np.zeros(len(raw) + 1, bool)
    begins[1:-1] = ENDS[kind[:-1] << 3 | kind[1:]]
    blank = np.flatnonzero(kind >= SPACE)
    blank = blank[(blank > 0) & (blank < len(raw) - 1)]
    last = np.zeros(len(raw), bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    seen = lambda p: (kind[p] >= LETTER) & (kind[p] <= APOSTROPHE)
    blank = blank[seen(blank - 1) & seen(blank + 1) & ~last[blank]]
    begins[blank] = True
    begins[blank[kind[blank] == FEED] + 1] = True
    begins[at] = True
    return np.flatnonzero(begins[:-1])


def slices(values: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls."""
    _, offsets, data = values.buffers()
    at, whole = np.frombuffer(offsets, np.int32, len(values) + 1, 4 * values.offset).tolist(), data.to_pybytes()
    return [whole[i:j] for i, j in zip(at, at[1:], strict=False)]


class Encoder:
    """Ids of texts as one call of the library for each text would give them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        split = self.tokenizer.pre_tokenizer
        pattern = json.loads(split.__getstate__()) if split else {}  # not of the whole file, whose vocabulary would be parsed with it
        self.cuttable = self.tokenizer.normalizer is None and type(self.model).__name__ == "BPE" and all(pattern.get(k) == v for k, v in PATTERN.items())
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = alphabet()
        self.blank = chr(self.shown[32])
        self.units: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, unit: bytes) -> bytes:
        if unit in self.older:
            self.units[unit] = made = self.older[unit]
            return made
        text = unit.decode()
        if PIECE.fullmatch(text):  # the library's own pattern leaves it whole, so its model can have it at once
            shown = text.replace(" ", self.blank) if text.isascii() else unit.decode("latin-1").translate(self.shown)
            ids = [t.id for t in self.model.tokenize(shown)]
            made = struct.pack(f"<{len(ids)}I", *ids)
        else:
            made = self.plain(text)
        if len(unit) <= UNIT_BYTES:
            self.units[unit] = made
        return made

    def _texts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of the texts in them)."""
        whole = raw.tobytes()
        if not self.cuttable or any(s in whole for s in self.special):
            made = [self.plain(whole[i:j].decode()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return np.frombuffer(b"".join(made), "<u4"), np.cumsum([0, *map(len, made)]) // 4
        begins = cuts(raw, at)
        edges, ids, sizes = np.append(begins, len(raw)), [], []
        for i in range(0, len(begins), UNITS_AT_ONCE):
            some = edges[i : i + UNITS_AT_ONCE + 1]
            data = pa.py_buffer(whole[some[0] : some[-1]])
            units = pa.Array.from_buffers(pa.binary(), len(some) - 1, [None, pa.py_buffer((some - some[0]).astype(np.int32)), data]).dictionary_encode()
            known = slices(units.dictionary)
            if len(self.units) > UNIT_LIMIT:
                self.older, self.units = self.units, {}
            made = [*map(self.units.get, known)]
            if None in made:
                made = [self.learn(u) if m is None else m for u, m in zip(known, made, strict=True)]
            pool, size = np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4
            code = units.indices.to_numpy()
            first, n = (np.cumsum(size) - size)[code], size[code]
            ids.append(pool[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            sizes.append(n)
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        return np.concatenate(ids) if ids else np.empty(0, "<u4"), total[np.searchsorted(begins, at)]

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of some texts of a string column after others, with the bounds of each text in them; null texts are empty."""
        raw, at = joined(column)
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + TEXT_BYTES, "right")) - 1)
            yield self._texts(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release() -> None:
    """Gives a worker's encoders back to the system, before tasks that need none: workers stay between the stages of a pipeline."""
    if _encoders:
        _encoders.clear()
        trim()


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
