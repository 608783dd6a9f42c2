"""How good answers are: shared words, numbers within tolerance, points named, refusals in their place. Column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.scoring import rate
from assaymill.functions.text import answer_key

#: A number, perhaps with thousands' commas, and the unit right behind it.
NUMBER = r"(?<![A-Za-z\p{Nd}.,])([-+]?\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?)\s*(" + "|".join(sorted(S.UNIT_FACTORS, key=len, reverse=True)) + ")?"


def words(c: Column) -> Column:
    """Words in lower case; of Chinese text each character is one."""
    return F.regexp_extract_all(answer_spaced(c), F.lit(r"[一-鿿]|[\p{L}\p{M}\p{Nd}&&[^一-鿿]]+"), F.lit(0))


def answer_spaced(c: Column) -> Column:
    """Half-width and in lower case, as answers are compared, but with their spaces."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), S.WIDE, S.NARROW)


def overlap(a: Column, b: Column) -> Column:
    """How many entries two lists share, each as often as both have it."""
    times = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    return F.aggregate(F.transform(F.array_intersect(a, b), lambda t: F.least(times(a, t), times(b, t))), F.lit(0), lambda n, x: n + x)


def token_f1(answer: Column, gold: Column) -> Column:
    """(precision, recall, f1) of an answer's words against the gold answer's; both empty is a full match, one empty none."""
    a, g = words(answer), words(gold)
    shared, n, m = overlap(a, g).cast("double"), F.size(a), F.size(g)
    none = (n == 0) & (m == 0)
    p, r, f = F.try_divide(shared, n.cast("double")), F.try_divide(shared, m.cast("double")), F.try_divide(2 * shared, (n + m).cast("double"))
    return F.struct(*[F.when(none, 1.0).otherwise(F.coalesce(x, F.lit(0.0))).alias(name) for x, name in ((p, "precision"), (r, "recall"), (f, "f1"))])


def numbers(c: Column) -> Column:
    """All numbers of a text, in base units: 3万 is 30000, 5% is 0.05, 1,200.5 is 1200.5."""
    text = answer_spaced(c)
    values = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2))
    factors = F.create_map(*[F.lit(x) for pair in S.UNIT_FACTORS.items() for x in pair])
    return F.zip_with(values, units, lambda v, u: F.regexp_replace(v, ",", "").try_cast("double") * F.coalesce(F.try_element_at(factors, u), F.lit(1.0)))


def numeric_match(answer: Column, gold: Column, relative: float = 0.01, absolute: float = 1e-9) -> Column:
    """Whether the answer names every number of the gold answer within the tolerance; null where the gold answer has none.

    A range in the gold answer (``3~5``, ``3-5``, ``3到5``, ``3至5``) is met by any number in it, or by its own ends.
    """
    text, found = answer_spaced(gold), numbers(answer)
    ranges = r"(\p{Nd}+(?:\.\p{Nd}+)?)\s*(?:~|-|到|至|–|—)\s*(\p{Nd}+(?:\.\p{Nd}+)?)\s*(" + "|".join(sorted(S.UNIT_FACTORS, key=len, reverse=True)) + ")?"
    part = lambda i: F.regexp_extract_all(text, F.lit(ranges), F.lit(i))
    factors = F.create_map(*[F.lit(x) for pair in S.UNIT_FACTORS.items() for x in pair])
    scaled = lambda v, u: v.try_cast("double") * F.coalesce(F.try_element_at(factors, u), F.lit(1.0))
    spans = F.transform(F.arrays_zip(part(1).alias("lo"), part(2).alias("hi"), part(3).alias("u")), lambda x: F.struct(scaled(x["lo"], x["u"]).alias("lo"), scaled(x["hi"], x["u"]).alias("hi")))
    single = numbers(F.regexp_replace(text, ranges, " "))
    near = lambda x, lo, hi: (x >= lo - F.greatest(F.abs(lo) * relative, F.lit(absolute))) & (x <= hi + F.greatest(F.abs(hi) * relative, F.lit(absolute)))
    named = F.forall(single, lambda g: F.exists(found, lambda x: near(x, g, g)))
    ranged = F.forall(spans, lambda s: F.exists(found, lambda x: near(x, s["lo"], s["hi"])))
    return F.when(F.size(single) + F.size(spans) > 0, named & ranged)


def point_recall(answer: Column, points: Column) -> Column:
    """The share of an answer's required points (a list of texts) that it holds, compared as answers are; null without points."""
    said = answer_key(answer)
    keys = F.filter(F.transform(points, answer_key), lambda p: p != "")
    return F.try_divide(F.size(F.filter(keys, lambda p: F.contains(said, p))).cast("double"), F.nullif(F.size(keys), F.lit(0)).cast("double"))


def refuses(answer: Column) -> Column:
    """Whether an answer declines: it is blank or says so in one of the fixed phrases."""
    said = answer_key(answer)
    return (said == "") | F.exists(F.array(*[answer_key(F.lit(p)) for p in S.REFUSALS]), lambda p: F.contains(said, p))


def refusal_rates(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., total, to_refuse, refused, correct_refusal, wrong_refusal, refusal_accuracy) of rows with ``answer`` and ``answerable``.

    ``correct_refusal`` is the share declined of what has no answer, ``wrong_refusal`` that of what has one; null without any.
    """
    no, yes = refuses(F.col("answer")), F.coalesce(F.col("answerable"), F.lit(True))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~yes).alias("to_refuse"), F.count_if(no).alias("refused"), F.count_if(no & ~yes).alias("_right"), F.count_if(no & yes).alias("_wrong"), F.count_if(no != yes).alias("_fit")
    )
    out = {"correct_refusal": rate(F.col("_right"), F.nullif(F.col("to_refuse"), F.lit(0)), None), "wrong_refusal": rate(F.col("_wrong"), F.nullif(F.col("total") - F.col("to_refuse"), F.lit(0)), None)}
    return sums.withColumns(out | {"refusal_accuracy": rate(F.col("_fit"), F.nullif(F.col("total"), F.lit(0)), None)}).drop("_right", "_wrong", "_fit")
