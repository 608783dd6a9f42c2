"""Personal data in texts: patterns propose spans, checksums confirm them, context words score them.

``find_pii`` returns a row per text with all confirmed spans; ``redact_pii`` replaces them.
Null texts count as empty and have no span; ties in start are ordered by kind; repeated rows
each get their own result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, whole_text

#: Kinds in the order in which spans of one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can start only where a run of digits starts, so runs are tried once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

#: Score of a confirmed span without context, what a context word near it adds, and the reach in characters.
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": ("mail", "contact", "correo", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "fax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
}
CONTEXT_GAIN, REACH = 0.3, 40
NEAR = {kind: re.compile(r"\b(?:" + "|".join(words) + r")", re.IGNORECASE) for kind, words in CONTEXT.items()}

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, top_score double"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    """Country and check digits go last, letters count from 10; the remainder must be 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each ``@`` is tried with the local part that ends at it."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL_PART))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every confirmed span by start, then kind as listed; code points."""
    found = [(s, e, "email") for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((m.start(), m.end(), "phone"))
    for m in IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            found.append((m.start(), m.end(), "iban"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def score(text: str, start: int, end: int, kind: str) -> float:
    around = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    return min(1.0, PRIOR[kind] + CONTEXT_GAIN * bool(NEAR[kind].search(around)))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: counts by kind, digest of the base spans, all spans, the highest score."""
    ready(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = spans_of(t)
                base = [x for x in spans if x[2] in BASE_KINDS]
                n = {k: sum(x[2] == k for x in spans) for k in KINDS}
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((doc_id, *(n[k] for k in BASE_KINDS), digest, listed(spans), n["iban"], max((score(t, *x) for x in spans), default=0.0)))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return whole_text(docs, key, text).withColumn(key, F.col(key).cast("long")).mapInArrow(find, SCHEMA)


def redacted(text: str, least: float) -> str:
    """Spans that score at least ``least`` become ``[KIND]``; overlapping spans become the first one's."""
    out, done, open_end = [], 0, -1
    for s, e, k in spans_of(text):
        if score(text, s, e, k) < least:
            continue
        if s < open_end:
            open_end = max(open_end, e)
        else:
            if open_end >= 0:
                done = open_end
            out += [text[done:s], f"[{k.upper()}]"]
            open_end = e
        done = open_end
    return "".join([*out, text[done:]])


def redact_pii(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", least: float = 0.5) -> DataFrame:
    """The same rows and columns with personal data replaced and the length counted anew.

    Null texts stay null; texts without a span stay as they are; null and repeated keys are of no matter, and an
    empty table gives no rows.
    """
    ready(docs.sparkSession)
    at, counted = docs.columns.index(text), docs.columns.index(n_chars) if n_chars in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, least) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted is not None:
                columns[counted] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)
