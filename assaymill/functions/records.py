"""Rows as they are shown or sent: time stamps, flags, masked secrets, evidence texts, display labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.scoring import mapped


def iso(c: Column) -> Column:
    """A time stamp in ISO form, with microseconds only where it has any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def utc_now() -> Column:
    return F.concat(iso(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())), F.lit("Z"))


def record(df: DataFrame, times: tuple[str, ...] = (), flags: tuple[str, ...] = (), secrets: tuple[str, ...] = ()) -> DataFrame:
    """Time stamps as ISO text, numbers 0 and 1 as booleans, and maps of settings with their secrets masked."""
    new = {c: iso(F.col(c)) for c in times} | {c: F.col(c).cast("int") != 0 for c in flags} | {c: masked(F.col(c)) for c in secrets}
    return df.withColumns(new)


def without_secrets(config: Column) -> Column:
    """A map of settings without its secrets."""
    return F.map_filter(config, lambda k, v: ~k.isin(S.SECRETS))


def masked(config: Column) -> Column:
    """A map of settings with stars in place of secrets that are set."""
    return F.transform_values(config, lambda k, v: F.when(k.isin(S.SECRETS) & (F.coalesce(v, F.lit("")) != ""), F.lit("***")).otherwise(v))


def given(c: Column) -> Column:
    """Null where a text is empty."""
    return F.nullif(c, F.lit(""))


def evidence_text(evidence: Column, *fields: str, empty: str = S.DASH) -> Column:
    """The quoted texts of an array of evidence, the first field that has one of each, joined."""
    texts = F.transform(evidence, lambda e: F.coalesce(*[given(e[f]) for f in fields or ("block_text", "content", "text")]))
    return F.coalesce(given(F.array_join(F.array_compact(texts), S.JOINT)), F.lit(empty))


def evidence_sections(evidence: Column) -> Column:
    return F.coalesce(given(F.array_join(F.array_compact(F.transform(evidence, lambda e: given(e["section_path"]))), S.JOINT)), F.lit(S.NO_SECTION))


def evidence_source(evidence: Column) -> Column:
    """Where the first piece of evidence with a place comes from."""
    places = F.array_compact(F.transform(evidence, lambda e: F.coalesce(given(e["section_path"]), given(e["source"]))))
    return F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(S.DASH))


def statement_section(section: Column, evidence: Column) -> Column:
    """The statement's own section, else those of its evidence."""
    return F.coalesce(given(section), evidence_sections(evidence))


def question_type(kind: Column) -> Column:
    """The kind of a question about a statement: the statement's own, and the plain rule for kinds that aren't known."""
    return F.when(kind.isin(S.STATEMENT_TYPES), kind).otherwise("rule")


def status_label(c: Column) -> Column:
    return F.coalesce(mapped(given(c), S.STATUS_LABELS, given(c)), F.lit(S.NO_STATUS))


def difficulty_label(c: Column) -> Column:
    return F.coalesce(mapped(given(c), S.DIFFICULTY_LABELS, given(c)), F.lit(S.DASH))


def review_label(c: Column) -> Column:
    return F.coalesce(mapped(c, S.REVIEW_LABELS, F.lit(None)), F.lit(S.UNREVIEWED))


def type_label(c: Column) -> Column:
    return F.coalesce(mapped(c, S.TYPE_LABELS, F.lit(None)), F.lit(S.TYPE_LABELS["rule"]))


def priority_label(c: Column) -> Column:
    return F.coalesce(mapped(c, S.PRIORITY_LABELS, F.lit(None)), F.lit(S.PRIORITY_LABELS["P2"]))


def label(columns: Sequence[str]) -> Column:
    """Some columns as one text that is equal where all of them are; null where one of them is."""
    return F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x), F.to_json(F.struct(*columns))) if columns else F.lit(None).cast("string")
