"""Text rules as column expressions: all run inside Spark's generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaymill import schemas as S


def trimmed(c: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def statement_key(c: Column) -> Column:
    """Without numbering in front and stops at the end, in lower case."""
    bare = F.regexp_replace(trimmed(F.coalesce(c, F.lit(""))), r"(?U)^\s*(?:\(?[0-9０-９]+\)?[.、]\s*)+", "")
    return F.lower(trimmed(F.regexp_replace(trimmed(bare), r"(?U)[。；;，,、\s]+$", "")))


def question_key(c: Column) -> Column:
    """Without white space and punctuation, per cent signs of either width alike, in lower case."""
    signs = "[" + re.escape(S.QUESTION_SIGNS) + "]"
    return F.lower(F.regexp_replace(F.regexp_replace(squeezed(F.coalesce(c, F.lit(""))), signs, ""), "％", "%"))


def answer_key(c: Column) -> Column:
    """Half-width digits and signs, no white space, in lower case."""
    return squeezed(F.translate(F.lower(trimmed(F.coalesce(c, F.lit("")))), S.WIDE, S.NARROW))


def dedup_key(c: Column) -> Column:
    """Only Chinese characters, Latin letters and digits, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\u4e00-\\u9fa5a-zA-Z0-9]", ""))


def cleaned_statement(c: Column) -> Column:
    numbering = r"(?U)^(?:[（(]\s*[一二三四五六七八九十\d]+\s*[）)]|[①②③④⑤⑥⑦⑧⑨⑩]+|\d+\s*[、.．])"
    return trimmed(F.regexp_replace(trimmed(F.regexp_replace(trimmed(c), numbering, "")), r"(?U)[。；;\s]+$", ""))


def truncated(c: Column, most: int = S.MAX_STATEMENT) -> Column:
    """At most ``most`` characters: up to the last stop of the first kind found, else comma, else cut."""
    cut = F.substring(c, 1, most)
    out = F.when(F.length(c) <= most, c)
    for stop in ("。", "；", "！", "？", "\n", "，"):
        end = F.length(cut) - F.instr(F.reverse(cut), stop) + 1
        out = out.when(F.contains(cut, F.lit(stop)) & (end > 1), F.substring(cut, F.lit(1), end))
    return out.otherwise(cut)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[。；;\n]+"), trimmed), lambda s: s != "")


def skippable(c: Column) -> Column:
    """Blank, very short, only digits and signs, or a short transition line."""
    s = trimmed(F.coalesce(c, F.lit("")))
    words = s.rlike("|".join(map(re.escape, S.SKIP_WORDS)))
    return (F.length(s) <= 2) | s.rlike(r"(?U)^[0-9\s\-—.·/\\|，,、]+$") | (words & (F.length(s) < 40))


def classified(c: Column) -> Column:
    """(eiu_type, content_priority) by the first rule that holds; null where nothing can be tested.

    Texts without a Chinese character are tried only against the rules that can hold for them.
    """
    pair = lambda kind, priority: F.struct(F.lit(kind).alias("eiu_type"), F.lit(priority).alias("content_priority"))

    def first(rules: list) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for kind, priority, patterns in rules:
            out = out.when(reduce(Column.__and__, [c.rlike("(?U)" + p) for p in patterns]), pair(kind, priority))
        return out.when(F.length(c) >= 8, pair("rule", "P2"))

    short, chinese = F.length(F.coalesce(c, F.lit(""))) < 4, c.rlike("[㐀-鿿]")
    return F.when(short, F.lit(None)).when(chinese, first(S.RULES)).otherwise(first([r for r in S.RULES if r[0] in S.RULES_OF_ANY]))


def first_of(c: Column, words: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words])


def found(c: Column, pattern: str, most: int | None = None) -> Column:
    """What the pattern's group finds, of ``most`` characters at most; null where it finds nothing. It is searched for once."""
    fits = lambda m: (m != "") if most is None else (m != "") & (F.length(m) <= most)
    return F.get(F.filter(F.array(F.regexp_extract(c, "(?U)" + pattern, 1)), fits), F.lit(0))


def constraints(c: Column) -> Column:
    """Subject, condition, scope, period, currency and unit that a sentence names; null where it names none."""
    some = reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in S.CONDITION_WORDS])  # without them every start of the pattern is tried in vain
    return F.struct(
        found(c, S.SUBJECT).alias("subject"), F.when(some, found(c, S.CONDITION, 40)).alias("condition"), F.lit(None).cast("string").alias("scope"),
        F.when(F.contains(c, F.lit("年")), found(c, r"(\d{4}年)")).alias("period"), first_of(c, S.CURRENCIES).alias("currency"), first_of(c, S.UNITS).alias("unit"),
    )


def tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?U)([\w一-鿿]+)"), F.lit(1)), F.lower)


def line_kind(c: Column) -> Column:
    """(block_type, level, text) of a line of Markdown; blank lines give null."""
    s = trimmed(c)
    marks = F.regexp_extract(s, r"(?U)^(#{1,6})\s+(?s:.*)$", 1)
    make = lambda kind, level, text: F.struct(F.lit(kind).alias("block_type"), level.cast("int").alias("level"), text.alias("text"))
    title = trimmed(F.regexp_extract(s, r"(?U)^#{1,6}\s+((?s:.*))$", 1))
    item = s.rlike(r"(?U)^([-*+]|\d+[.)])\s+")
    return F.when(marks != "", make("title", F.length(marks), title)).when(s == "", None).when(item, make("list_item", F.lit(None), s)).otherwise(make("paragraph", F.lit(None), s))


def unfenced(c: Column) -> Column:
    """A reply without its code fence."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(trimmed(c))


def json_list(c: Column, schema: str, wrappers: tuple[str, ...] = ("items", "eius", "variants", "checks", "results")) -> Column:
    """Items of a reply: a bare array, an object that wraps one, one object, or the first bracketed part."""
    raw = unfenced(F.coalesce(c, F.lit("")))
    sliced = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    wrapped = [F.from_json(F.get_json_object(raw, f"$.{w}"), f"array<{schema}>") for w in wrappers]
    bare = F.when(raw.startswith("["), F.from_json(raw, f"array<{schema}>"))
    single = F.when(raw.startswith("{"), F.filter(F.array(F.from_json(raw, schema)), lambda x: x.isNotNull()))
    none = F.array().cast(f"array<{schema}>")
    items = F.coalesce(bare, *wrapped, F.when(sliced != "", F.from_json(sliced, f"array<{schema}>")), single, none)
    return F.when(F.contains(c, F.lit("[")) | F.contains(c, F.lit("{")), items).otherwise(none)  # a reply without either has no item, whatever its fence


def reply_text(c: Column) -> Column:
    """The answer of a model's response: its output, else its first choice, else the response itself."""
    return F.coalesce(F.get_json_object(c, "$.output"), F.get_json_object(c, "$.choices[0].message.content"), F.get_json_object(c, "$.choices[0].text"), c)
