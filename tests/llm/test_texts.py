"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from assaymill.llm import common, decontamination, jaccard, packing, pii, substrings, token_output, tokens

SCHEMA = "doc_id long, text string, lang string, n_chars long, kind string, region string"


def docs(spark, texts, first=0):
    rows = [(i, t, "en", None if t is None else len(t), "x", "y") for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA)


def words(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def corpus(seed=1):
    r = Random(seed)
    base = [words(r, 120) for _ in range(6)]
    line = words(r, 60)
    near = []
    for b in base[:3]:
        ws = b.split()
        for k in (1, 2, 3, 9):
            x = list(ws)
            for i in range(k):
                x[(i * 37) % len(x)] = f"z{r.randrange(99)}"
            near.append(" ".join(x))
    shared = [words(r, 50) + " " + line + " " + words(r, 50) for _ in range(6)]
    junk = ["", None, " \n\t ", "one two", "ONE two", "a " * 4000, "x" * 700, "été " * 90, words(r, 3000), "\U0001f600" * 80]
    return base + [base[0]] * 3 + near + shared + junk + ["A@b.co"] * 2


@pytest.fixture(scope="module")
def everything(spark):
    return docs(spark, corpus()).cache()


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_pii_matches_plain_patterns(spark):
    texts = [
        "mail a.b@c.de_x@y.z.w and 10.0.0.1, 256.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "+49 (30) 1234567, +1 2 3",
        "é4111111111111111 a@b.c @x.y a@b", "iban DE89 3704 0044 0532 0130 00", None, "", "1" * 20000, "a@" * 3000, "x" * 20000 + "@b.co",
    ]
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    got = collected(pii.find_pii(docs(spark, texts)))
    for i, t in enumerate(texts):
        t, found = t or "", []
        for k, p in patterns.items():
            for m in re.finditer(p, t) if len(t) < 5000 or k != "email" else []:
                d = re.sub("[^0-9]", "", m[0])
                rules = {"email": lambda: True, "ip": lambda: all(len(x) < 9 and int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}
                ok = rules[k]()
                if ok:
                    found.append((m.start(), pii.KINDS.index(k), k, m.end()))
        if len(t) >= 5000:
            found = [x for x in found if x[2] != "email"] + ([(0, 0, "email", len(t))] if t.endswith("@b.co") else [])
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (i, text, got[i].spans)
    assert got[4].n_iban == 1 and got[5].spans == "" and got[6].n_email == 0


def test_redaction_keeps_columns_and_clean_texts(spark):
    df = docs(spark, ["write a@b.co now", None, "clean"])
    out = pii.redact_pii(df)
    rows = collected(out)
    assert out.columns == df.columns and rows[0].text == "write [EMAIL] now" and rows[0].n_chars == 17
    assert rows[1].text is None and rows[2].text == "clean"


def library():
    return Tokenizer.from_file(tokens.vocabulary())


def encoded(e, texts):
    return [ids[i:j].tolist() for ids, at in e.encode(pa.array(texts, pa.string())) for i, j in zip(at[:-1], at[1:], strict=True)]


def test_encoder_equals_library(monkeypatch):
    odd = ["a  b\n\n c\t d 12 it's 's x½y", "<|endoftext|> a\n b", "a <|endoftext|>b", " lead", "trail \n", "x　y 漢字", "\n", " ", "a×b÷c'd 'll x''s !'s 's5", "\0 \0a b", "Ünïcode—dash a1b2 ɏɐʰ"]
    texts, lib = [*corpus(), *odd], library()
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    e = tokens.Encoder(tokens.vocabulary())
    assert encoded(e, texts) == want
    assert encoded(e, [t for t in texts if not t or "endoftext" not in t]) == [w for t, w in zip(texts, want, strict=True) if not t or "endoftext" not in t]
    monkeypatch.setattr(tokens, "TEXT_BYTES", 50)
    monkeypatch.setattr(tokens, "UNITS_AT_ONCE", 7)
    monkeypatch.setattr(tokens, "UNIT_LIMIT", 30)
    assert encoded(tokens.Encoder(tokens.vocabulary()), texts) == want


def test_encoder_on_random_texts():
    r, lib, e = Random(4), library(), tokens.Encoder(tokens.vocabulary())
    parts = ["a", "B", "é", "×", "÷", "'", "'s", "'ll", "'t", " ", "  ", "\n", "\t", "12", "3", ".", "!!", "ɐ", "ɏ", "ʰ", "漢", "\U0001f600", "\0", "\x7f", "\x85", "\xa0", "ü", "word", "’", "½", "²", "Ⅷ", "\r"]
    texts = ["".join(r.choices(parts, k=r.randrange(14))) for _ in range(20_000)]
    assert encoded(e, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoders_are_given_back(spark):
    """A worker that scores quality after it encoded holds no encoder."""
    from assaymill.llm import quality

    model = quality.Boosted(9.0, *(np.zeros((0, n)) for n in (31, 31, 32)))
    tokens.encoder(tokens.vocabulary())
    held = lambda it: map(lambda b: pa.RecordBatch.from_pydict({"n": pa.array([len(tokens._encoders)], pa.int32())}), it)
    one = spark.range(1).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1)
    packing.pieces(one, tokens.vocabulary(), 2, 1024).collect()
    quality.keep_good(one, model).collect()
    assert {r.n for r in one.mapInArrow(held, "n int").collect()} <= {0}
    tokens.release()
    assert not tokens._encoders


def test_no_encoder_parses_its_vocabulary_again(monkeypatch):
    """What an encoder asks its file is the pattern; the vocabulary as text and as Python objects stayed in each worker."""
    asked = []
    monkeypatch.setattr(tokens.json, "loads", lambda text, known=tokens.json.loads: asked.append(len(text)) or known(text))
    assert tokens.Encoder(tokens.vocabulary()).cuttable
    assert max(asked) < 10_000


def test_shared_counts_hold_little(monkeypatch):
    """Two blocks of sets are compared by narrow stretches of their shingles, with the same counts."""
    sets, held = [np.unique(np.random.default_rng(i % 7).integers(0, 1 << 40, 9000, np.uint64)) for i in range(24)], []
    monkeypatch.setattr(jaccard, "incidence", lambda *a, made=jaccard.incidence: held.append(made(*a)) or held[-1])
    counts = jaccard.shared_counts(sets, sets)
    assert counts.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert max(x.nbytes / len(x) for x in held) * jaccard.BLOCK <= 4 << 20


def test_token_files_round_trip(spark, everything, monkeypatch):
    monkeypatch.setattr(token_output, "IDS_A_FILE", 500)
    monkeypatch.setattr(tokens, "TEXT_BYTES", 2000)
    lib = library()
    got, at = collected(token_output.tokenized(everything)), 0
    for i, t in enumerate(corpus()):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_output.tokenized(everything.limit(0)).count() == 0


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, most in ((1, 1), (1, 900), (300, 5), (1000, 10**6), (257, 1)):
        v = np.cumsum(r.integers(0, most + 1, n))
        ef = token_output.EliasFano.encode(v)
        assert ef.values().tolist() == v.tolist() and [ef.select(i) for i in range(0, n, 7)] == v[::7].tolist()
    keys, ef, ids = token_output.unpack_file(token_output.pack_file([None, 5, 5], np.array([1, 1, 4]), np.array([7, 8, 9, 10], "<u2")))
    assert keys == [None, 5, 5] and ef.values().tolist() == [1, 1, 4] and ids.tolist() == [7, 8, 9, 10]


def test_packing_is_whole_and_tight(spark, everything):
    lib = library()
    rows = packing.pack(everything).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(corpus()):
        ids, at = lib.encode(t or "", add_special_tokens=False).ids + [2], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack(everything.limit(0)).count() == 0


def test_packing_of_batches_that_are_cut(spark):
    """Texts of one Arrow batch that the encoder takes in several parts keep their own ids, to the last document."""
    texts = {i: " ".join(f"w{i} {j * j}" for j in range(i * 97 % 4000)) for i in range(120)}
    assert sum(map(len, texts.values())) > 3 * tokens.TEXT_BYTES
    library, want = Tokenizer.from_file(tokens.vocabulary()), {}
    for i, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        for k, (at, n) in enumerate(packing.pieces_of(len(ids), 1024)):
            want[i, k] = (at, n, zlib.crc32(ids[at : at + n].tobytes()))
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want


def test_packing_plan_places_every_piece():
    r = Random(3)
    for _ in range(30):
        counts = {n: r.randrange(1, 40) for n in r.sample(range(1, 65), r.randrange(1, 20))}
        made = packing.plan(counts, 64)
        total = {}
        for _, times, taken in made:
            assert sum(n * c for n, c in taken.items()) <= 64
            for n, c in taken.items():
                total[n] = total.get(n, 0) + c * times
        assert total == counts


def sets(texts):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def grouped(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard_join_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r, texts = Random(block), corpus(block)
    chain = words(r, 60).split()  # each links with the next only
    for k in range(12):
        texts.append(" ".join(chain))
        chain = chain[3:] + [f"q{k}a", f"q{k}b", f"q{k}c"]
    s = sets(texts)
    want = grouped(len(s), lambda i, j: bool(s[i]) and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]))
    got = collected(jaccard.join_sets(docs(spark, texts)))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(s))] == [(len(x), c) for x, c in zip(s, want, strict=True)]


def test_jaccard_edges(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", None]).unionByName(spark.createDataFrame([(None, "a b c d e f", "en", 1, "", "")], SCHEMA))
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_sets(df).collect()), key=str)
    assert rows == sorted([(0, 2, 0), (1, 2, 0), (2, 0, 2), (None, 2, None)], key=str)
    assert jaccard.join_sets(df.limit(0)).count() == 0
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "2", "None"]


@pytest.mark.parametrize("rows", [500_000, 0])
def test_decontamination_is_exact(spark, everything, monkeypatch, rows):
    monkeypatch.setattr(common, "ROWS_AT_ONCE", rows)
    texts = corpus()
    items = [(7, texts[0][20:200]), (10, "one two"), (9, texts[-15]), (3, None), (None, "one two"), (11, ""), (12, texts[0][20:200].upper()), (10, "one two")]
    got = collected(decontamination.decontaminate(everything, spark.createDataFrame(items, "item_id long, text string")))
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        for k in range(max(1, len(w(t)) - 9) if i is not None and w(t) else 0):
            windows.setdefault(tuple(w(t)[k : k + 10]), set()).add(str(i))
    for i, t in enumerate(texts):
        ws, hit, found = w(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(ws) - n + 1):
                if x := windows.get(tuple(ws[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= x
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(ws), len(hit), len(found), digest, bool(hit))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(everything, none).where("contaminated").count() == 0
    kept = decontamination.drop_contaminated(everything, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == everything.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeated_substrings_are_exact(spark, everything, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    texts = [(t or "").encode() for t in corpus()]
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    got = collected(substrings.remove_repeats(everything))
    for d, t in enumerate(texts):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), d
    assert substrings.remove_repeats(everything.limit(0)).count() == 0


def edited(r, n, size=80):
    """Texts that each differ from one text in one word of their own."""
    ws = words(r, size, 10**6).split()
    return [" ".join([*ws[:i], f"e{i}", *ws[i + 1 :]]) for i in range(5, 5 + n)]


def test_jaccard_copies_and_few_edits(spark):
    r = Random(5)
    near = edited(r, 5)
    texts = [words(r, 40, 10**6) for _ in range(20)] + near + [near[0]] * 3000
    got = collected(jaccard.join_sets(docs(spark, texts)))
    assert [got[i].component_id for i in range(len(texts))] == [*range(20), *[20] * 3005]


def test_jaccard_lone_members_of_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LEVEL", 1)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    texts = [*edited(Random(6), 3), *edited(Random(7), 7), *edited(Random(8), 20), *corpus()]
    s = sets(texts)
    want = grouped(len(s), lambda i, j: bool(s[i]) and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]))
    got = collected(jaccard.join_sets(docs(spark, texts)))
    assert [got[i].component_id for i in range(len(s))] == want


def test_repeated_substrings_without_or_with_shared_keys(spark):
    r = Random(9)
    line = "p" + "".join(r.choices("abcdefgh ", k=210))
    texts = [(None, "first " * 3 + "/" + line + "?"), (1, "one-" + line + "!"), (4, words(r, 70)), (4, "again+" + line + ".")]
    texts += [(2, texts[2][1]), (None, "only here " * 2 + words(r, 60))]
    got = substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    whole = texts[2][1]
    want = [(k, len(t), *((len(t), "") if t == whole else (len(line), t.replace(line, "")) if line in t else (0, t))) for k, t in texts]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.kept_sha256) for x in got) == sorted((str(k), n, m, sha(t)) for k, n, m, t in want)


def test_jaccard_one_key_with_two_texts(spark):
    a, b = ([*edited(Random(i), 2, n)] for i, n in ((20, 80), (21, 120)))
    rows = [(5, a[0]), (5, b[0]), (7, a[1]), (3, b[1]), (9, "something else that is alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_sets(df).collect())
    assert got == [(3, 116, 3), (5, 76, 5), (5, 116, 3), (7, 76, 5), (9, 2, 9)]
    assert sorted(tuple(r) for r in jaccard.keep_one(df).collect()) == sorted([rows[0], rows[3], rows[4]])
