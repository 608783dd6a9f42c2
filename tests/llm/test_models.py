"""Trained models on held-out rows, vectors against brute force, and the pipeline's stages."""

import numpy as np
import pytest

from assaymill.llm import embeddings, graph, html, quality, queries, toxicity
from assaymill.llm.common import table

SF = "/root/testdata/sf0.01"


def accuracy(spark, df, label):
    labels = table(spark, SF, "labels")
    rows = df.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return np.mean([r.predicted == r[label] for r in rows])


@pytest.mark.parametrize(("module", "run", "score", "label"), [(quality, "op4_quality", "score_quality", "quality"), (toxicity, "op2_toxicity", "score_toxicity", "toxic")])
def test_classifier(spark, module, run, score, label):
    df = queries.queries()[run](spark, SF).cache()
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert df.count() == table(spark, SF, "documents").count() and df.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert accuracy(spark, df, label) >= 0.9
    docs = spark.createDataFrame([(1, None, "a", "s"), (2, "", "b", "s"), (2, "", "b", "s"), (None, "x " * 50_000, "c", "s")], "doc_id long, text string, label string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.train(docs, none)
    assert getattr(module, score)(docs, model).count() == 4
    assert getattr(module, score)(docs.limit(0), model).count() == 0


def test_boosted_trees_learn_a_rule():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    m = quality.Boosted.fit(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_subwords_reach_unseen_spellings():
    clean = [f"quiet words number {i} about gardens and rain" for i in range(60)]
    bad = [f"quiet words number {i} about grumblo{'xyzw'[i % 4]} and rain" for i in range(60)]
    m = toxicity.SubwordSoftmax.fit(clean + bad, [0] * 60 + [1] * 60, rounds=20)
    texts = ["number 77 about grumbloq and rain", "number 77 about gardens and rain", ""]
    raw = "".join(texts).encode()
    s = m.score(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]))
    assert s[0] > 0.5 > s[1] and s[2] == 0


def test_field_finds_main_text():
    field = html.trained()
    wrong = total = 0
    for seed in range(9000, 9080):
        blocks, labels = html.labelled(seed)
        wrong += sum(a != b for a, b in zip(labels, field.decode(html.features_of(blocks)), strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total


def test_html_edges(spark):
    page = (
        "<html><head><title>T</title><script>if(a<b){'</p>'}</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='ad'>Buy now.</div>"
        "<article><h1>Caf&eacute; &amp; co</h1><p><b>One\n two.<br>three<p>Four &lt;five&gt;.</p><form><p>Name?</p></form></article><div id=comments><p>First!</p></div><footer>&copy; x</footer></body></html>"
    )
    rows = [(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "<p", 0), (1, "u", page, 0), (5, "u", "<div>" * 3000 + "x", 0)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    one = [r for r in got if r.page_id == 1]
    assert len(got) == 6 and len(one) == 2
    assert one[0].text == "Café & co\n\nOne two. three\n\nFour <five>." and one[0].n_chars == len(one[0].text)
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3))


def linked_pairs(ids, vectors, labels, threshold=0.93):
    """All pairs of rows that link, by their places."""
    ok = [x is not None and len(x) > 0 and None not in x and np.isfinite(x).all() and np.any(x) and y is not None and i is not None for i, x, y in zip(ids, vectors, labels, strict=True)]
    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i]), np.array(vectors[j])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    yield i, j


@pytest.mark.parametrize("small", [False, True])
def test_embeddings_against_brute_force(spark, monkeypatch, small):
    if small:  # many parts, blocks and groups of pairs
        for name, value in (("PART_BYTES", 16 * 20), ("PART_LEAST", 4), ("BLOCK", 3), ("COLUMNS", 5), ("PAIRS_AT_ONCE", 2), ("CENTRES", 3)):
            monkeypatch.setattr(embeddings, name, value)
    r = np.random.default_rng(5)
    base = r.normal(size=(12, 16))
    v = np.concatenate([base[r.integers(0, 12, 150)] + r.normal(size=(150, 16)) * r.choice([0.02, 0.2, 1], (150, 1)), base[:3].repeat(4, 0)])
    vectors = [x.tolist() for x in v] + [None, [0.0] * 16, [float("nan")] * 16, [], [1.0, None], [1.0] * 3, [1.0] * 3]
    labels = [int(i % 3) for i in range(len(vectors))]
    labels[5] = None
    labels[-1] = labels[-2]
    ids = list(range(len(vectors)))
    df = spark.createDataFrame([(i, x, y, "z") for i, x, y in zip(ids, vectors, labels, strict=True)], "vec_id long, embedding array<double>, label int, id string")
    n, links, comp = len(vectors), {}, list(range(len(vectors)))
    for i, j in linked_pairs(ids, vectors, labels):
        links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
        lo, hi = sorted((comp[i], comp[j]))
        comp = [lo if c == hi else c for c in comp]
    got = {x.vec_id: x for x in embeddings.near_duplicates(df).collect()}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(n)] == [(links.get(i, 0), comp[i], comp[i] == i) for i in range(n)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.99, 0.1], 0), (1, [1.0, 0.0], 0), (2, [0.98, 0.1], 0), (None, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_duplicates(df).collect())
    assert got == sorted([("1", 3, "1")] * 3 + [("2", 3, "1"), ("None", 0, "None"), ("3", 0, "3"), ("4", 0, "4")])


def test_cover_trees_save_work_on_clusters():
    r = np.random.default_rng(1)
    points = embeddings.unit(r.normal(size=(40, 32))[r.integers(0, 40, 4000)] + r.normal(size=(4000, 32)) * 0.01)
    tree, ones = embeddings.CoverTree(points), np.ones(4000, np.int64)
    pair = embeddings.Pair(tree, tree, ones, ones, 0.93)
    assert pair.tests < 0.2 * 4000**2 and (pair.counts[0] == (tree.points @ tree.points.T >= 0.93).sum(1) - 1).all()


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
