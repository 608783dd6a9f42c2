"""Repair of conversations against a plain search over (cost, edits), on given and on random rows."""

import hashlib
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache
from random import Random

import pytest

from assaymill.llm import dialogue

sys.setrecursionlimit(20_000)  # of the plain search, for the long conversation
SCHEMA = "conv_id long, turn long, role string, text string, ckey string, fault int, digest string"
SPACE = r"[^\x20\x09-\x0D]"


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def best(rows):
    """(cost, audit) of [(initial, fault)], by trying everything."""

    @lru_cache(None)
    def go(i, state, inserted):
        after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state]
        want = "a" if state == "u" else "u"
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            c, e = go(i, want, inserted + 1)
            found.append((c + 2, "I" + e))
        if i < len(rows):
            initial, fault = rows[i]
            c, e = go(i + 1, state, 0)
            found.append((c + 3, "D" + e))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if initial in after:
                    c, e = go(i + 1, after[initial], 0)
                    found.append((c + more, "K" + e))
                c, e = go(i + 1, want, 0)
                found.append((c + 2 + more, "R" + e))
        return min(found, default=(10**9, ""))

    return go(0, "", 0)


def expected(rows, every):
    by = defaultdict(list)
    for row in rows:
        by[row[0]].append(row)
    out = {}
    for c in every:
        own = sorted(by.get(c, []), key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        turns = {t for _, t, *_ in own if t is not None}
        seen, faults = set(), []
        for _, _, r, x in own:
            last = re.findall(SPACE, x)[-1:]
            faults.append("blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((r, x))
        initials = [r[:1] for _, _, r, _ in own]
        cost, audit = best(tuple(zip(initials, faults, strict=True))) if own else (0, "")
        made, at, state = [], 0, ""
        for letter in audit:
            want = "assistant" if state == "u" else "user"
            if letter == "I":
                made.append((want, ""))
            else:
                if letter != "D":
                    made.append((own[at][2] if letter == "K" else want, own[at][3]))
                at += 1
            state = made[-1][0][0] if letter != "D" else state
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made))
        text = "\n".join(f"{r}:{x}" for r, x in made)
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
        out[c, "made"] = made
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(df, rows, every=None):
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in dialogue.repair(df, every).collect()}
    want = expected(rows, got)
    assert set(got) == {r[0] for r in rows} | ({r.conv_id for r in every.collect()} if every else set())
    for c, r in got.items():
        assert r == want[c], c
    return want


def some_rows(seed=1, n=120):
    r = Random(seed)
    roles = ("user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "u")
    texts = ("Yes.", "No", "", " \n", None, "Is it? ", "a" * 3000 + "!", "x.", "é…")
    rows = []
    for c in range(n):
        for t in range(r.choice((1, 2, 4, 6, 9))):
            rows += [(c, r.choice((t, t, t, t + 3, None, 1)), r.choice(roles), r.choice((f"T{t}.", *texts)))] * r.choice((1, 1, 1, 2))
    return rows + [(None, t, "user", "Hm.") for t in (1, 2, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 9, "d") for r in rows], SCHEMA)


def plain(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("part", [4096, 1, 3])
def test_random_conversations(spark, monkeypatch, part):
    """In whole, and with all conversations cut in parts."""
    monkeypatch.setattr(dialogue, "PART", part)
    rows = some_rows(part)
    check(frame(spark, rows).repartition(3), plain(rows))


def test_given_table_with_damage(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(repr, map(tuple, dialogue.damaged(df).collect()))) == sorted(map(repr, damage(rows)))
    check(dialogue.damaged(df), damage(rows), df)
    odd = [(i, t, None, None) for i in range(60) for t in (None, 3)] + [(None, None, "user", "A.")]
    check(dialogue.damaged(frame(spark, odd)), damage(odd), frame(spark, odd))


def test_rows_of_the_repair(spark, monkeypatch):
    for part in (4096, 2):
        monkeypatch.setattr(dialogue, "PART", part)
        rows = some_rows(7, 40)
        want = expected(plain(rows), {r[0] for r in rows})
        got = defaultdict(dict)
        for r in dialogue.repaired(frame(spark, rows)).collect():
            if r.place is not None:
                assert r.edit != "D" and r.place not in got[r.conv_id]
                got[r.conv_id][r.place] = (r.role, r.text)
        for c in {r[0] for r in rows}:
            assert [got[c][k] for k in range(len(got[c]))] == want[c, "made"]


def test_one_conversation_of_most_rows(spark, monkeypatch):
    """Its parts lie in several tasks, and none of them holds it; so do the copies of one row."""
    monkeypatch.setattr(dialogue, "PART", 16)
    r = Random(2)
    rows = [(5, t, r.choice(("user", "assistant", "assistant", "system")), r.choice((f"T{t}.", f"t{t}", "Again."))) for t in range(300)]
    rows += [(6, 1, "user", "Same.")] * 150 + [(7, 0, "user", "Hi."), (7, 1, "assistant", "Hello.")]
    check(frame(spark, rows).repartition(4), rows)


def test_no_rows(spark):
    assert dialogue.repair(frame(spark, [])).collect() == [] == dialogue.repaired(frame(spark, [])).collect()
    wide = [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B.")]
    assert dialogue.repair(frame(spark, wide)).first().gaps is None
    gone = dialogue.repair(frame(spark, []), frame(spark, [(3, 1, "user", "x")])).first()
    assert tuple(gone) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_buckets_equal_plain_search():
    r = Random(4)
    for _ in range(400):
        kinds = tuple(r.randrange(16) for _ in range(r.randrange(9)))
        named = tuple(("s", "u", "a", "x")[k // 4] for k in kinds), tuple(("", "truncated", "blank", "duplicate")[k % 4] for k in kinds)
        assert dialogue.solved(kinds) == best(tuple(zip(*named, strict=True)))
