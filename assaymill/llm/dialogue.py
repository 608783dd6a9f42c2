"""Repair of conversation structure: faults of rows, and the cheapest edits to an alternating conversation.

Rows are put in order once, over all conversations. A task goes along its stretch of that order in parts of bounded
length; a conversation that lies in one part is solved there. For the others a part gives the costs between its ends
as four by four numbers, these are added up from the last part to the first, and each part is then walked with the
costs behind it known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, run_folder, small_or_joined, spread, stored

#: Rows of a part, rows that a sequence makes at a time.
PART = 4096
#: Conversations of at most so many rows are remembered by their kinds of rows, so many at a time.
SHORT, REMEMBERED = 64, 65_536
FAR = 1 << 60
#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row with this initial; a number for each initial, 3 for all others.
AFTER = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Faults of a row; rows with one of the last two must go.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: What may be inserted: the state after it and its role.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: Costs behind the last row: insertions until an assistant row, or no row at all, is the end.
ENDS = [0, 2 * INSERT, INSERT, 0]


def moves(kind: int) -> list[list[tuple[str, int, int]]]:
    """For each state (letter, cost, next state) of the edits of a row of a kind: initial's number times 4 and fault."""
    initial, fault = divmod(kind, 4)
    out: list[list[tuple[str, int, int]]] = []
    for state in range(4):
        out.append([("D", DELETE, state)])
        if fault in (FINE, TRUNCATED):
            more = CUT if fault == TRUNCATED else 0
            if state in AFTER[initial]:
                out[state].append(("K", more, AFTER[initial][state]))
            out[state].append(("R", REROLE + more, NEXT[state][0]))
    return out


MOVES = [moves(kind) for kind in range(16)]
BACK = [[[(cost, state) for state in range(4) for _, cost, to in MOVES[kind][state] if to == end] for end in range(4)] for kind in range(16)]
INSERTED_TO = [[state for state in range(4) if NEXT[state][0] == end] for end in range(4)]


def distances(kinds: list[int] | tuple[int, ...], ends: list[int]) -> list[int]:
    """The least cost from (row, state), at 4 * row + state, to what lies behind the last row, by Dial's buckets.

    A bucket holds the nodes of one distance; as all costs are small whole numbers, buckets are emptied one after the
    other and nothing needs a heap. Insertions come before a row; those behind the last row are in ``ends``.
    """
    n = len(kinds)
    found = [FAR] * (4 * n + 4)
    base = min(ends)
    buckets: list[list[int]] = [[]]

    def reach(node: int, distance: int) -> None:
        if distance < found[node]:
            found[node] = distance
            while len(buckets) <= distance:
                buckets.append([])
            buckets[distance].append(node)

    for state, cost in enumerate(ends):
        if cost < FAR:
            reach(4 * n + state, cost - base)
    at = 0
    while at < len(buckets):
        for node in buckets[at]:  # grows meanwhile by arcs that cost nothing
            if found[node] != at:
                continue
            row, end = divmod(node, 4)
            if row < n:
                for state in INSERTED_TO[end]:
                    reach(4 * row + state, at + INSERT)
            if row:
                for cost, state in BACK[kinds[row - 1]][end]:
                    reach(4 * row - 4 + state, at + cost)
        buckets[at] = []
        at += 1
    return [d if d == FAR else d + base for d in found]


def walk(kinds: list[int] | tuple[int, ...], cost: list[int], state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits from a state, along arcs whose cost is exactly what the distance falls; and the state after them.

    A letter leads to one node only, so the least letter at each step makes the least string.
    """
    out, row = [], 0
    while row < len(kinds):
        here = cost[4 * row + state]
        options = [(letter, 4 * row + 4 + to) for letter, c, to in MOVES[kinds[row]][state] if here == c + cost[4 * row + 4 + to]]
        if here == INSERT + cost[4 * row + NEXT[state][0]]:
            options.append(("I", 4 * row + NEXT[state][0]))
        letter, node = min(options)
        out.append(letter)
        row, state = divmod(node, 4)
    return "".join(out), state


def ending(state: int) -> str:
    return "I" * (ENDS[state] // INSERT)


def solved(kinds: tuple[int, ...]) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    cost = distances(kinds, ENDS)
    audit, state = walk(kinds, cost, START)
    return cost[START], audit + ending(state)


@lru_cache(REMEMBERED)
def remembered(kinds: tuple[int, ...]) -> tuple[int, str]:
    """The same for short conversations, most of which are of few kinds."""
    return solved(kinds)


def illegal_pairs(kinds: list[int] | tuple[int, ...]) -> int:
    return sum((a // 4, b // 4) not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))


def edited(audit: str, rows: list[tuple[str, str]], state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) for each letter; deleted rows as they were."""
    left = iter(rows)
    for letter in audit:
        to, named = NEXT[state]
        if letter == "I":
            yield letter, named, ""
            state = to
            continue
        role, text = next(left)
        if letter != "D":
            role = role if letter == "K" else named
            state = AFTER[INITIALS[role[0]]][state]
        yield letter, role, text


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Test damage, by crc32 of ``conversation:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes out its
    full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    rows = conversations.select(conv, turn, said(role).alias(role), said(text).alias(text), harm.alias("_harm")).where(F.col("_harm") != 0)
    spoilt = F.when(F.col("_harm") == 1, F.lit("")).when(F.col("_harm") == 2, F.translate(F.col(text), ".!?", "")).otherwise(F.col(text))
    rows = rows.withColumns({text: spoilt, role: F.when(F.col("_harm") == 4, F.lit("user")).otherwise(F.col(role))})
    return rows.withColumn("_times", F.explode(F.when(F.col("_harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_harm", "_times")


def _key(c: Column) -> Column:
    """Keys as text, null ones with a text of their own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def faults(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(ckey, turn, digest, copy, role, text, fault): rows in any order, with the number of each first fault.

    Rows that are alike in all are counted first and counted out again, so that many of them don't meet in one task.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(_key(F.col(conv)).alias("ckey"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    rows = rows.groupBy("ckey", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumns({"digest": F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary")), "when": F.struct(F.col("turn").isNotNull().alias("given"), "turn")})
    first = rows.groupBy("ckey", "digest").agg(F.min("when").alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1").drop("turns")
    rows = rows.join(first, ["ckey", "digest"], "left").withColumn("again", F.coalesce(F.col("when") > F.col("first"), F.lit(False)))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / PART))))
    copy = F.sequence(F.col("block") * PART, F.least("times", (F.col("block") + 1) * PART) - 1)
    rows = rows.withColumn("copy", F.explode(copy))
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.col("again") | (F.col("copy") > 0), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return rows.select("ckey", "turn", "digest", "copy", "role", "text", fault.alias("fault"))


MADE = "made array<struct<edit:string,role:string,text:string,place:int>>"
PARTS = "ckey string, at long, illegal long, cost long, audit string, repaired_sha256 string, ends array<int>, between array<long>, rows array<struct<role:string,text:string,kind:int>>, " + MADE


def _shown(made: list[tuple[str, str, str]]) -> list[dict]:
    """Edits as records; those that stay have a place among them."""
    out, place = [], 0
    for edit, role, text in made:
        out.append({"edit": edit, "role": role, "text": text, "place": None if edit == "D" else place})
        place += edit != "D"
    return out


def _texts(made: list[tuple[str, str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for edit, role, text in made if edit != "D").encode("utf-8", "surrogatepass")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, list]]:
    """(ckey, at, whole, rows) of a task's ordered rows: parts of one conversation each, of at most PART rows.

    The first and the last conversation of a task may go on in another one, so they never count as whole.
    """
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("ckey", "at", "role", "text", "fault")), strict=True))
    waiting, opening = None, True
    for ckey, own in groupby(rows, key=lambda r: r[0]):
        number = 0
        while True:
            some = [r for _, r in zip(range(PART), own, strict=False)]
            if not some and number:
                break
            if waiting:
                yield waiting
            number += 1
            waiting = (ckey, some[0][1], False, [(role, text, 4 * INITIALS.get(role[:1], 3) + fault) for _, _, role, text, fault in some])
            if len(some) < PART:
                break
        if number == 1 and not opening:
            waiting = (*waiting[:2], True, waiting[3])
        opening = False
    if waiting:
        yield (*waiting[:2], False, waiting[3])


def _records(rows: list[dict]) -> pa.RecordBatch:
    made = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("place", pa.int32())])
    schema = pa.schema([
        ("ckey", pa.string()), ("at", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("ends", pa.list_(pa.int32())),
        ("between", pa.list_(pa.int64())), ("rows", pa.list_(_ROW)), ("made", pa.list_(made)),
    ])
    return pa.RecordBatch.from_pylist(rows, schema)


def _batched(rows: Iterator[dict], make: Callable[[list[dict]], pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    weight = 0
    for r in rows:
        held.append(r)
        weight += 1 + len(r.get("rows") or ()) + len(r.get("made") or ())
        if weight >= size:
            yield make(held)
            held, weight = [], 0
    if held:
        yield make(held)


def _parts(show: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole conversations are solved, parts of others get the costs from each state before them to each state behind them."""

    def records(batches):
        for ckey, at, whole, rows in _stretches(batches):
            kinds, texts = tuple(k for *_, k in rows), [(role, text) for role, text, _ in rows]
            out = {"ckey": ckey, "at": at, "illegal": illegal_pairs(kinds)}
            if whole:
                cost, audit = remembered(kinds) if len(kinds) <= SHORT else solved(kinds)
                made = list(edited(audit, texts, START))
                yield out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(_texts(made)).hexdigest(), "made": _shown(made) if show else None}
            else:
                to = [distances(kinds, [0 if s == end else FAR for s in range(4)])[:4] for end in range(4)]
                yield out | {"ends": [kinds[0] // 4, kinds[-1] // 4], "between": [to[end][start] for start in range(4) for end in range(4)], "rows": [{"role": r, "text": t, "kind": k} for r, t, k in rows]}

    def task(batches):
        return _batched(records(batches), _records, PART)

    return task


def _behind(parts: pd.DataFrame) -> pd.DataFrame:
    """For the parts of one conversation, sixteen numbers each: the least costs behind each part."""
    parts = parts.sort_values("at")
    ends, out = ENDS, []
    for between in reversed(parts["between"].tolist()):
        out.append(ends)
        ends = [min(min(between[4 * s + e] + ends[e] for e in range(4)), FAR) for s in range(4)]
    return pd.DataFrame({"ckey": parts["ckey"], "at": parts["at"], "behind": out[::-1]})


_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("kind", pa.int32())])
_WALKED = pa.schema([
    ("ckey", pa.string()), ("at", pa.int64()), ("illegal", pa.int64()), ("ends", pa.list_(pa.int32())), ("rows", pa.list_(_ROW)),
    ("audits", pa.list_(pa.string())), ("states", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())),
])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the edits of a part and the state after it for each state before it."""

    def records():
        for b in batches:
            for r in b.to_pylist():
                kinds = [x["kind"] for x in r["rows"]]
                cost = distances(kinds, r.pop("behind"))
                walks = [walk(kinds, cost, s) if cost[s] < FAR else ("", s) for s in range(4)]
                yield r | {"audits": [a for a, _ in walks], "states": [s for _, s in walks], "costs": cost[:4]}

    return _batched(records(), lambda rows: pa.RecordBatch.from_pylist(rows, _WALKED), PART)


def _merged(show: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a conversation from its parts in order, part by part; with ``show`` a row a part with its edits, and a last one."""

    def records(batches):
        parts = (r for b in batches for r in b.to_pylist())
        for ckey, own in groupby(parts, key=lambda r: r["ckey"]):
            state, before, digest, first = START, None, hashlib.sha256(), True
            out = {"ckey": ckey, "illegal": 0, "cost": None}
            audits = []
            for r in own:
                out |= {"at": r["at"], "cost": r["costs"][START] if out["cost"] is None else out["cost"]}
                out["illegal"] += r["illegal"] + (before is not None and (before, r["ends"][0]) not in LEGAL)
                before, audit = r["ends"][1], r["audits"][state]
                made = list(edited(audit, [(x["role"], x["text"]) for x in r["rows"]], state))
                state = r["states"][state]
                if show:
                    yield {"ckey": ckey, "at": r["at"], "made": _shown(made)}
                if any(e != "D" for e, *_ in made):
                    digest.update(b"" if first else b"\n")
                    digest.update(_texts(made))
                    first = False
                audits.append(audit)
            made = list(edited(ending(state), [], state))
            if made:
                digest.update((b"" if first else b"\n") + _texts(made))
            yield out | {"audit": "".join(audits) + ending(state), "repaired_sha256": digest.hexdigest(), "made": _shown(made) if show else None}

    def task(batches):
        return _batched(records(batches), _records, PART)

    return task


def _solutions(rows: DataFrame, show: bool) -> DataFrame:
    """PARTS rows: one a conversation with its results, and with ``show`` its edits, in parts where it is long."""
    spark = rows.sparkSession
    order = ["ckey", F.asc_nulls_first("turn"), "digest", "copy"]
    ordered = rows.repartitionByRange(spread(spark), *order).sortWithinPartitions(*order)
    ordered = ordered.select("ckey", F.monotonically_increasing_id().alias("at"), "role", "text", "fault")
    parts = stored(ordered.mapInArrow(_parts(show), PARTS), "parts")
    long = parts.where("between IS NOT NULL")
    behind = long.select("ckey", "at", "between").groupBy("ckey").applyInPandas(_behind, "ckey string, at long, behind array<long>")
    walked = long.select("ckey", "at", "illegal", "ends", "rows").join(behind, ["ckey", "at"]).select("ckey", "at", "illegal", "ends", "rows", "behind")
    walked = walked.mapInArrow(_walks, "ckey string, at long, illegal long, ends array<int>, rows array<struct<role:string,text:string,kind:int>>, audits array<string>, states array<int>, costs array<long>")
    merged = walked.repartition(spread(spark), "ckey").sortWithinPartitions("ckey", "at").mapInArrow(_merged(show), PARTS)
    return parts.where("between IS NULL").unionByName(merged)


def repair(conversations: DataFrame, every: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Rows go by turn, null turns first, rows of one turn by the md5 of role and text. ``every`` may name conversations
    (column ``conv``) that have no rows here: zeros, no edits, the hash of nothing.

    Null roles and texts are one space; null conversation keys are one conversation, and come back as null. Empty
    and very long texts are rows like others. A gap that a long can't hold is null. An empty table gives no rows. Only
    the named columns are read. A conversation may hold any number of rows: its parts are worked on apart, a task
    holds one of them at a time, and only sixteen numbers of each part meet. Its audit is one text, and its hash is by
    nature computed along all of it, as a stream.
    """
    with run_folder(conversations.sparkSession, "dialogue"):
        rows = stored(faults(conversations, conv, turn, role, text), "rows")
        count = lambda f: F.count_if(F.col("fault") == f)
        turns = rows.groupBy("ckey", "turn").agg(*[count(f).alias(n) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))])
        span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn")
        sums = turns.groupBy("ckey").agg(F.when(F.count("turn") == 0, 0).otherwise(span).alias("gaps"), F.count("turn").alias("given"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
        sums = sums.select("ckey", F.when(F.col("given") == 0, F.lit(0).cast("long")).otherwise(F.col("gaps").try_cast("long")).alias("gaps"), "blank", "duplicate", "truncated")
        found = _solutions(rows, False).select("ckey", "illegal", "cost", "audit", "repaired_sha256")
        names = (conversations if every is None else every.select(conv).union(conversations.select(conv))).select(F.col(conv).alias(conv)).distinct().withColumn("ckey", _key(F.col(conv)))
        out = names.join(sums.join(found, "ckey").withColumn("_there", F.lit(True)), "ckey", "left")
        zero = [F.when(F.col("_there"), F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        none = hashlib.sha256(b"").hexdigest()
        return kept(out.select(conv, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256")), "repairs")


def repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, edit, role, text): the rows of the cheapest repair with the edit that made each; deleted ones have no place. Odd rows as in ``repair``."""
    with run_folder(conversations.sparkSession, "dialogue"):
        rows = stored(faults(conversations, conv, turn, role, text), "rows")
        parts = stored(_solutions(rows, True).where("made IS NOT NULL").select("ckey", "at", F.col("audit").isNotNull().alias("last"), "made"), "edits")
        parts = parts.withColumn("n", F.size(F.filter("made", lambda m: m["edit"] != "D")).cast("long"))
        sizes = parts.groupBy("ckey").agg(F.array_sort(F.collect_list(F.struct("at", "last", "n"))).alias("sizes"))  # three numbers a part
        before = F.aggregate(F.filter("sizes", lambda x: (x["at"] < F.col("at")) | ((x["at"] == F.col("at")) & ~x["last"] & F.col("last"))), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        many = parts.groupBy("ckey").count().where("count > 1").select("ckey")
        sizes = sizes.join(small_or_joined(many), "ckey", "left_semi")
        each = parts.join(sizes, "ckey", "left").withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
        each = each.select("ckey", "before", F.explode("made").alias("m"))
        names = conversations.select(F.col(conv).alias(conv)).distinct().withColumn("ckey", _key(F.col(conv)))
        return kept(each.select("ckey", (F.col("before") + F.col("m.place")).alias("place"), "m.edit", F.col("m.role").alias(role), F.col("m.text").alias(text)).join(names, "ckey").drop("ckey"), "repaired")
