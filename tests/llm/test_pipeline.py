"""The pipeline against plain Python versions of its stages, its edges, and models against scalar arithmetic."""

import os
import re
import zlib
from pathlib import Path
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from assaymill.llm import common, decontamination, jaccard, packing, pii, quality, token_output, tokens, toxicity
from assaymill.llm.common import table
from tests.llm.test_texts import grouped, sets

SF = "/root/testdata/sf0.001"


def walked(model, x):
    """One row down all trees, node by node."""
    total, inner = model.base, model.feature.shape[1]
    for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
        node = 0
        while node < inner:
            node = 2 * node + 1 + (x[feature[node]] > threshold[node])
        total += value[node - inner]
    return 1 / (1 + np.exp(-total))


def numbers(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return quality.statistics(raw, np.array([0, len(raw)]))[0]


def test_trees_equal_a_scalar_walk(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    for r in docs.collect():
        want = walked(model, numbers(r.text or ""))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def gram_numbers(word):
    """Buckets of a word's n-grams with an edge at either end, one byte after another."""
    edged = bytes([toxicity.EDGE]) + word + bytes([toxicity.EDGE])
    for k in toxicity.GRAMS:
        for i in range(len(edged) - k + 1):
            h = 0
            for b in edged[i : i + k]:
                h = (h ^ (b + 1) * 0x9E3779B1 % 2**32) * 0x01000193 % 2**32
                h ^= h >> 15
            yield (h ^ k * 0x85EBCA6B % 2**32) % toxicity.BUCKETS


def test_toxicity_equals_a_scalar_sum(spark):
    r = np.random.default_rng(3)
    model = toxicity.SubwordSoftmax(r.normal(size=toxicity.BUCKETS), -0.3)
    texts = ["Some words, some more WORDS and été", "a b c", "", "x", "one-two three\nfour five six seven eight " * 3, "!!!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, model).collect()}
    for i, t in enumerate(texts):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
        bags = [[model.weight[b] for b in gram_numbers(w)] for w in words]
        best = -np.inf
        for k in range(len(words)):
            some = sum(bags[max(0, k - toxicity.WORDS + 1) : k + 1], [])
            best = max(best, sum(some) / max(len(some), 1))
        assert abs(got[i] - (1 / (1 + np.exp(-(best + model.bias))) if words else 0)) < 1e-9, t


def test_null_keys_are_in_no_fold(spark):
    docs = spark.createDataFrame([(None, "one two"), (3, "one two")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, score in ((quality, quality.score_quality), (toxicity, toxicity.score_toxicity)):
        assert [r.held_out for r in score(docs, module.train(docs, none)).collect() if r.doc_id is None] == [False]


def redacted_text(text, spans):
    """Spans that score enough, those that overlap joined under the first one's kind."""
    runs = []
    for s, e, k in spans:
        if pii.score(text, s, e, k) >= 0.5:
            if runs and s < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e, k])
    for s, e, k in reversed(runs):
        text = text[:s] + f"[{k.upper()}]" + text[e:]
    return text


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of the smallest tables with planted copies, leaks, personal data and bare rows."""
    folder = tmp_path_factory.mktemp("sf")
    docs = table(spark, SF, "documents").collect()
    good = [r for r in docs if r.text and 60 < len(r.text.split()) < 400][:40]
    items = table(spark, SF, "benchmark").collect()
    r, rows = Random(1), [tuple(x) for x in docs[:120]]
    for n, g in enumerate(good):
        ws = g.text.split()
        ws[r.randrange(len(ws))] = "edited"
        leak = " ".join(ws[:20]) + " " + items[n % len(items)].text + " " + " ".join(ws[20:])
        rows += [(10_000 + n, g.text, g.lang, g.source, g.n_chars), (20_000 + n, " ".join(ws), g.lang, g.source, 0), (30_000 + n, leak, g.lang, g.source, 0)]
        rows.append((40_000 + n, " ".join(reversed(ws)) + f" mail me at user{n}@mail.example or 10.0.0.{n}, phone +49 30 {1234567 + n}.", g.lang, g.source, 0))
    rows += [(50_000, None, "en", "s", None), (50_001, "", "en", "s", 0), (None, good[0].text, "en", "s", 0), (50_002, good[1].text, None, None, None), (50_002, good[1].text, None, None, None)]
    spark.createDataFrame(rows, table(spark, SF, "documents").schema).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_equals_plain_python(spark, tables):
    docs, labels, items = (table(spark, tables, n) for n in ("documents", "labels", "benchmark"))
    model = quality.train(docs, labels)
    rows = [r for r in map(tuple, docs.collect()) if walked(model, numbers(r[1] or "")) >= 0.7]
    assert 20 < len(rows) < docs.count()

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))  # the smallest key of a group comes first
    rows = [rows[i] for i in order]
    s = sets([r[1] for r in rows])
    same = lambda i, j: bool(s[i]) and rows[i][0] is not None and rows[j][0] is not None and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])
    roots = grouped(len(rows), same)
    kept = [r for i, r in enumerate(rows) if r[0] is None or r[0] == rows[roots[i]][0]]
    assert len(kept) < len(rows)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for x in items.collect() for w in [words(x.text)] for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = [r for r in kept if not any(tuple(words(r[1])[i : i + n]) in windows for n in sizes for i in range(len(words(r[1])) - n + 1))]
    assert 0 < len(clean) < len(kept)

    bare = [(r[0], None if r[1] is None else redacted_text(r[1], pii.spans_of(r[1]))) for r in clean]
    assert any("[EMAIL]" in (t or "") for _, t in bare)

    lib, want = Tokenizer.from_file(tokens.vocabulary()), []
    for key, t in bare:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        for i, (start, n) in enumerate(packing.pieces_of(len(ids), 1024)):
            want.append((str(key), i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    pieces = corpus_pipeline.run(spark, tables).collect()
    assert sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == sorted(want)
    filled = {}
    for p in sorted(pieces, key=lambda p: p.offset):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 1024


def test_stages_keep_columns_and_clean_rows(spark, tables):
    docs = table(spark, tables, "documents")
    names, empty = docs.columns, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, tables).count() == 0, name
        after = stage(spark, docs, tables)
        assert after.columns == names and 0 < after.count() <= docs.count(), name
    # what has nothing to hide or to share stays as it is
    alone = spark.createDataFrame([(None, None, "en", "s", None), (1, "", "en", "s", 0), (2, "only this here", "en", "s", 14), (2, "and this too", "en", "s", 12)], docs.schema)
    for stage in (jaccard.keep_one, pii.redact_pii, lambda d: decontamination.drop_contaminated(d, table(spark, tables, "benchmark"))):
        assert sorted(map(str, stage(alone).collect())) == sorted(map(str, alone.collect()))
    assert corpus_pipeline.STAGES[-1][1](spark, empty, tables).count() == 0


def test_null_and_repeated_keys_in_packing_and_files(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "c"), (5, "c"), (5, None), (None, "")], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == sorted([("None", 3), ("5", 2), ("5", 2), ("5", 1), ("None", 1)])
    got = sorted(token_output.tokenized(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 5, 5, 5] and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


def test_intermediate_tables_go_and_settings_stay(spark, tmp_path):
    before, batch = set(os.listdir(common.shared_dir(spark))), spark.conf.get(common.BATCH)
    docs = spark.createDataFrame([(i, f"some words that are number {i} of them all") for i in range(20)], "doc_id long, text string").withColumn("x", F.lit(1))
    assert jaccard.keep_one(docs).count() == 20
    new = {Path(p).name.rsplit("-", 1)[0] for p in set(os.listdir(common.shared_dir(spark))) - before}
    assert new == {"near-copies"} and spark.conf.get(common.BATCH) == batch
    with pytest.raises(RuntimeError), common.run_folder(spark, "broken"):
        common.stored(docs, "x")
        raise RuntimeError
    assert not [p for p in os.listdir(common.shared_dir(spark)) if p.startswith("broken")]
