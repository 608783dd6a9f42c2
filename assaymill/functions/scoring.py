"""Numbers, scores and label maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.text import answer_key, trimmed


def mapped(c: Column, table: dict, default: Column | None = None) -> Column:
    """The entry of a small fixed table, or the default."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(default) if default is not None else out


def weight_of(weight: Column, priority: Column) -> Column:
    """The stored weight, or the priority's where it is null or zero; unknown priorities weigh 1."""
    return F.when(F.coalesce(weight, F.lit(0)) != 0, weight).otherwise(mapped(priority, S.PRIORITY_WEIGHT, F.lit(1)))


def rate(part: Column, whole: Column, empty: float | None, digits: int = 4) -> Column:
    """part / whole, rounded; ``empty`` where there is no whole."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty).cast("double")), digits)


def confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.8))))


def progress(done: Column, total: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(done * 100.0, total)), F.lit(0)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def difficulty(kind: Column, priority: Column) -> Column:
    return F.when((priority == "P0") | kind.isin(S.HARD_TYPES), "L2").otherwise("L1")


def next_version(latest: Column) -> Column:
    """The latest vX.Y.Z with one more in Z; v1.0.0 where there is none."""
    part = lambda i: F.regexp_extract(latest, r"^v(\d+)\.(\d+)\.(\d+)", i)
    number = lambda i: part(i).try_cast("int")
    known = F.coalesce(part(3), F.lit("")) != ""
    return F.when(known, F.format_string("v%d.%d.%d", number(1), number(2), number(3) + 1)).otherwise("v1.0.0")


def exact_match(answer: Column, gold: Column) -> Column:
    return answer_key(answer) == answer_key(gold)


def score_case(answer: Column, gold: Column, error: Column) -> Column:
    """(method, em, score): null score for errors and missing gold; without an encoder long answers match exactly too."""
    bare = trimmed(F.coalesce(gold, F.lit("")))
    skip = error.isNotNull() | (bare == "")
    em = exact_match(F.coalesce(answer, F.lit("")), bare)
    return F.struct(
        F.when(~skip, F.when(F.length(bare) > 30, "semantic").otherwise("exact_match")).alias("method"),
        F.when(~skip, em).alias("em"),
        F.when(~skip, em.cast("double")).alias("score"),
    )


def run_status(error: Column, score: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(score.isNull(), "unscored").when(score >= S.PASS_SCORE, "passed").otherwise("failed")


def diagnosis(answer: Column, gold: Column, error: Column, score: Column, n_retrieved: Column) -> Column:
    """Code of the likely cause; null where the case passed or can't be judged. ``n_retrieved``: null without a trace."""
    no_answer = trimmed(F.coalesce(answer, F.lit(""))) == ""
    return (
        F.when(error.isNotNull(), "D9")
        .when(trimmed(F.coalesce(gold, F.lit(""))) == "", F.when(no_answer, "D6"))
        .when(F.coalesce(score >= S.PASS_SCORE, F.lit(False)) | n_retrieved.isNull(), None)
        .when(n_retrieved == 0, "D3")
        .otherwise("D5")
    )


def advice(code: Column) -> Column:
    return mapped(code, S.ADVICE, F.lit(S.NO_ADVICE))


def size_label(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1024 / 1024))
