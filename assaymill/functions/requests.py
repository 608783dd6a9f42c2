"""What may be asked for: fields of requests checked as columns, each problem by its field's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaymill import schemas as S


def one_of(name: str, values: list[str]) -> Column:
    return F.when(~F.col(name).isin(values), name)


def longest(name: str, most: int) -> Column:
    return F.when(F.length(name) > most, name)


def filled(name: str) -> Column:
    """A text that may be absent, but not empty."""
    return F.when(F.length(name) < 1, name)


def required(name: str) -> Column:
    return F.when(F.coalesce(F.length(name), F.lit(0)) < 1, name)


def between(name: str, low: float, high: float) -> Column:
    return F.when(~F.col(name).between(low, high), name)


def small_json(name: str, most: int = S.MAX_CONSTRAINT_BYTES) -> Column:
    """A structure or map whose JSON has at most so many bytes in UTF-8."""
    return F.when(F.octet_length(F.to_json(name)) > most, name)


def problems(*checks: Column) -> Column:
    """The names of the fields that fail, in the order of the checks; null fields aren't checked but where required."""
    return F.array_compact(F.array(*checks))


def statement_edit() -> Column:
    """Of a patch to a statement."""
    return problems(
        longest("statement", S.MAX_STATEMENT), one_of("eiu_type", S.STATEMENT_TYPES), one_of("content_priority", list(S.PRIORITY_WEIGHT)), longest("exclusion_reason", S.MAX_REASON),
        small_json("constraints"), between("extraction_confidence", 0.0, 1.0),
    )


def case_revision() -> Column:
    """Of a revision of a candidate case."""
    return problems(
        filled("question"), one_of("question_type", S.STATEMENT_TYPES), one_of("difficulty", list(S.DIFFICULTY_LABELS)), filled("gold_answer"), one_of("content_priority", list(S.PRIORITY_WEIGHT))
    )


def uploaded_pair() -> Column:
    """Of a question and answer that a user sends."""
    return problems(
        required("question"), required("answer"), one_of("question_type", S.STATEMENT_TYPES), one_of("difficulty", list(S.DIFFICULTY_LABELS)), one_of("content_priority", list(S.PRIORITY_WEIGHT)),
        between("variation_count", 0, 10),
    )
