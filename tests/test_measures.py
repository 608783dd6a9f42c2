"""Measures by hand and against plain Python, with nulls, repeats and empty tables."""

import math
from random import Random

import pytest
from pyspark.sql import functions as F

from assaymill.operators import answers as A
from assaymill.operators import crosstabs as B
from assaymill.operators import latency as P
from assaymill.operators import retrieval as R


def test_sketches_merge_within_their_error(spark):
    """Sketches of runs, kinds and hours, rolled up to kinds: percentiles as near the exact ranks as stated, without the rows."""
    r = Random(1)
    rows = [(i % 7, "ab"[i % 2], f"2024-01-01 0{i % 5}:00:00", r.lognormvariate(3, 1)) for i in range(20_000)] + [(1, None, None, 5.0), (1, "a", None, None), (1, "a", None, math.nan)]
    df = spark.createDataFrame(rows, "run_id int, dimension string, ts string, latency_ms double").repartition(5)
    stored = P.sketched(df).cache()
    assert stored.count() == 7 * 2 * 5 + 1
    for by in ([], ["dimension"]):
        for x in P.percentiles(P.rolled_up(stored, by), (0.5, 0.95, 0.999)).collect():
            own = sorted(v for _, k, _, v in rows if v is not None and not math.isnan(v) and (not by or k == x.dimension))
            assert x.n == len(own) and x.mean == pytest.approx(sum(own) / len(own)) and (x.least, x.most) == (own[0], own[-1])
            for name, p in (("p50", 0.5), ("p95", 0.95), ("p99_9", 0.999)):
                assert abs(sum(v <= x[name] for v in own) / len(own) - p) <= P.RANK_ERROR + 1 / len(own)
    again = P.rolled_up(P.rolled_up(stored, ["run_id", "dimension"]), ["dimension"])
    assert {x.n for x in again.collect()} == {x.n for x in P.rolled_up(stored, ["dimension"]).collect()}
    assert P.percentiles(P.rolled_up(P.sketched(df.where("false")), ["dimension"])).collect() == []


def test_retrieval_by_hand(spark):
    traces = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "z", 1), (3, "a", 1), (None, "a", 1), (1, None, 1), (1, "q", None)], "query_id int, item_id string, rank int")
    gold = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", None), (1, "c", 1), (2, "a", None), (4, "a", 1), (5, "a", 0), (3, "a", -1), (None, "a", 1)], "query_id int, item_id string, grade int")
    got = {(x.query_id, x.k): x for x in R.retrieval_metrics(traces, gold, (1, 2, 5)).collect()}
    assert {q for q, _ in got} == {1, 2, 4}
    one = got[1, 5]
    ideal, gained = 3 / 1 + 1 / math.log2(3) + 1 / 2, 1 / math.log2(3) + 3 / math.log2(4)
    assert (one.n_gold, one.n_found, one.recall, one.hit, one.complete, one.mrr) == (3, 2, 2 / 3, 1, 0, 0.5)
    assert one.ndcg == pytest.approx(gained / ideal) and one.precision == 0.4 and one.context_precision == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert (got[1, 1].recall, got[1, 1].mrr, got[1, 1].ndcg, got[1, 2].hit) == (0, 0, 0, 1)
    assert all(getattr(got[q, k], m) == 0 for q in (2, 4) for k in (1, 2, 5) for m in R.METRICS)
    groups = spark.createDataFrame([(1, "m"), (2, "m")], "query_id int, kind string")
    by = {(x.kind, x.k): x for x in R.retrieval_summary(R.retrieval_metrics(traces, gold, (5,)), groups, ["kind"]).collect()}
    assert by["m", 5].questions == 2 and by["m", 5].recall == round(1 / 3, 6)


def test_first_causes(spark):
    """One failed result for each cause, where later causes hold as well."""
    schema = "query_id int, score double, error string, answerable boolean, sound boolean, represented boolean, faithful boolean, safe boolean"
    rows = [
        (1, 0.0, "timeout", False, None, None, None, None), (2, 1.0, None, False, None, None, None, None), (3, 0.0, None, False, False, None, None, None), (4, None, None, None, False, None, None, None), (5, 0.0, None, None, None, None, None, None),
        (6, 0.0, None, None, None, False, None, None), (7, 0.0, None, None, None, False, None, None), (8, 0.0, None, None, None, None, None, False), (9, 0.0, None, None, None, None, None, False), (10, 0.0, None, None, None, None, None, False), (11, 0.0, None, None, None, None, False, False),
    ]
    gold = [(q, "a") for q in (1, 2, 3, 4, 7, 8, 9, 10, 11)] + [(6, "lost"), (8, "b"), (8, "b"), (None, "a")]
    traces = [(8, "a", 1), (9, "x", 1), (9, "y", 2), (9, "a", 5), (10, "a", 1), (11, "a", 1), (11, "a", 2)]
    known = spark.createDataFrame([("a",), ("a",), ("b",)], "item_id string")
    out = R.diagnosed(spark.createDataFrame(rows, schema), spark.createDataFrame(traces, "query_id int, item_id string, rank int"), spark.createDataFrame(gold, "query_id int, item_id string"), known, k=3, budget=2)
    got = {x.query_id: x.diagnosis for x in out.collect()}
    assert got == {1: "D9", 2: None, 3: "D7", 4: "D6", 5: "D6", 6: "D1", 7: "D2", 8: "D3", 9: "D4", 10: "D8", 11: "D5"}


def test_answers_by_hand(spark):
    rows = [
        ("The cat sat", "the cat cat", 2 / 3, None), ("", "", 1.0, None), (None, "x", 0.0, None), ("利率为5%", "利率5%", 6 / 7, True), ("about 30,000 yuan", "3万元", 0.0, True), ("0.05", "５％", 0.0, True),
        ("4", "3~5", 0.0, True), ("6", "3到5万", 0.0, False), ("45000", "3到5万", 0.0, True), ("12 and 7", "7, 12", 0.8, True), ("12", "7 and 12", None, False), ("none", "7", 0.0, False), ("-3.5", "-3.5", 1.0, True), ("v1a2", "7", None, False),
    ]
    df = spark.createDataFrame([(i, a, g) for i, (a, g, *_) in enumerate(rows)], "i int, a string, g string")
    got = df.select("i", A.token_f1(F.col("a"), F.col("g"))["f1"].alias("f1"), A.numeric_match(F.col("a"), F.col("g")).alias("m")).orderBy("i").collect()
    for x, (a, g, f1, match) in zip(got, rows, strict=True):
        assert f1 is None or x.f1 == pytest.approx(f1), (a, g, x.f1)
        assert x.m == match, (a, g, x.m)


def test_points_and_refusals(spark):
    df = spark.createDataFrame([("A B, c", ["a b", "C", "d"], True), ("无法 回答", [], False), (None, None, True), ("Sorry, I cannot answer.", [" "], True), ("yes", ["yes"], None)], "answer string, points array<string>, answerable boolean")
    assert [x[0] for x in df.select(A.point_recall(F.col("answer"), F.col("points"))).collect()] == [pytest.approx(2 / 3), None, None, None, 1.0]
    x = A.refusal_rates(df).first()
    assert (x.total, x.to_refuse, x.refused, x.correct_refusal, x.wrong_refusal, x.refusal_accuracy) == (5, 1, 3, 1.0, 0.5, 0.6)
    assert A.refusal_rates(df.where("false"), ["answerable"]).collect() == []


def test_crosstab_margins(spark):
    rows = [("L1", "a", 1), ("L1", "a", 1), ("L1", None, 2), ("L2", "a", 3), (None, "b", 3)]
    df = spark.createDataFrame(rows, "difficulty string, kind string, eiu int")
    got = {(x.difficulty, x.kind, x.level): x for x in B.crosstab(df, ["difficulty", "kind"], ["eiu"], measures={"most": F.max("eiu")}).collect()}
    assert got["all", "all", 3].n == 5 and got["all", "all", 3].distinct_eiu == 3 and got["all", "all", 3].share == 1
    assert got["L1", "all", 1].n == 3 and got["L1", "all", 1].share == 0.6 and got["L1", "none", 0].n == 1 and got["none", "all", 1].most == 3
    assert got["L1", "a", 0].share == round(2 / 3, 6) and got["all", "a", 2].share == 0.6 and len(got) == 1 + 3 + 3 + 4
    some = B.crosstab(df, ["difficulty", "kind"], sets=[["kind"], []]).collect()
    assert {x.level for x in some} == {2, 3}
    risk = {x.difficulty: (x.share, x.risk) for x in B.concentration(B.crosstab(df, ["difficulty", "kind"]), "kind", "difficulty", "a").collect()}
    assert risk == {"L1": (round(2 / 3, 6), True), "L2": (1.0, True), "none": (0.0, False)}
