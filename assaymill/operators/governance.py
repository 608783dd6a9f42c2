"""Mandatory rules as data: a table of rules becomes one expression, and a case's violations are found in one pass."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.functions.text import answer_key, question_key

SEVERITIES = ("S0", "S1", "S2")


@dataclass(frozen=True)
class Rule:
    """A rule: what it looks for in which columns, and what is to be done where it is found.

    ``test`` is one of: ``matches`` (a pattern is found in a column), ``lacks`` (it is in none of them), ``blank`` (all columns are
    blank), ``above`` and ``below`` (a number in a column is beyond ``value``), ``among`` and ``outside`` (a column's value is, or
    isn't, in the list ``values``), ``differs`` (two columns aren't alike), ``sql`` (any Spark condition, in ``value``).
    ``unless`` is a pattern that, found in the same columns, excuses a row. Nulls are as empty texts; a number that is
    null is beyond nothing.
    """

    code: str
    columns: tuple[str, ...]
    test: str
    value: str = ""
    values: tuple[str, ...] = ()
    unless: str = ""
    severity: str = "S0"
    action: str = "block"

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES or self.test not in TESTS or not self.columns and self.test != "sql":
            raise ValueError(f"rule {self.code}: unknown severity or test, or no columns")

    def violated(self) -> Column:
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.columns]
        found = TESTS[self.test](self, texts)
        if self.unless:
            found = found & ~reduce(Column.__or__, [t.rlike(self.unless) for t in texts])
        return F.coalesce(found, F.lit(False))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__or__, conditions)


TESTS = {
    "matches": lambda r, t: _any([x.rlike(r.value) for x in t]),
    "lacks": lambda r, t: ~_any([x.rlike(r.value) for x in t]),
    "blank": lambda r, t: reduce(Column.__and__, [~x.rlike(r"(?U)\S") for x in t]),
    "above": lambda r, t: _any([x.try_cast("double") > float(r.value) for x in t]),
    "below": lambda r, t: _any([x.try_cast("double") < float(r.value) for x in t]),
    "among": lambda r, t: _any([x.isin(list(r.values)) for x in t]),
    "outside": lambda r, t: _any([~x.isin(list(r.values)) for x in t]),
    "differs": lambda r, t: _any([x != t[0] for x in t[1:]]),
    "sql": lambda r, t: F.expr(r.value),
}


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Rules from JSON lines, with the fields of ``Rule``."""
    return tuple(Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(line.value).items()}) for line in spark.read.text(path).collect() if line.value.strip())


def write_rules(spark: SparkSession, rules: Sequence[Rule], path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(r), ensure_ascii=False),) for r in rules], "value string").coalesce(1).write.text(path)


def judged(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``violations``, an array of (code, severity, action) in the rules' order, and ``blocked``: whether an S0 rule is among them.

    All rules are one projection over one scan; a new rule is a new row of data. Codes must differ.
    """
    if len({r.code for r in rules}) < len(rules):
        raise ValueError("rules with one code")
    hits = [F.when(r.violated(), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action"))) for r in rules]
    none = F.array().cast("array<struct<code:string,severity:string,action:string>>")
    found = F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else none
    return rows.withColumn("violations", found).withColumn("blocked", F.exists("violations", lambda v: v["severity"] == "S0"))


def rule_report(found: DataFrame, rules: Sequence[Rule], by: Sequence[str] = ()) -> DataFrame:
    """(by..., code, severity, rows, violations, rate): every rule, also those that nothing violates."""
    wanted = F.array(*[F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity")) for r in rules])
    each = found.select(*by, F.transform("violations", lambda v: v["code"]).alias("codes"), F.explode(wanted).alias("r"))
    sums = each.groupBy(*by, F.col("r.code").alias("code"), F.col("r.severity").alias("severity")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.array_contains("codes", F.col("r.code"))).alias("violations"))
    return sums.withColumn("rate", F.round(F.col("violations") / F.col("rows"), 6))


def released(rules: Sequence[Rule], before: Sequence[Rule]) -> dict[str, list[str]]:
    """How a new set of rules differs from the one in force: codes ``added``, ``changed`` and ``dropped``. S0 rules can't be dropped or weakened."""
    old, new = {r.code: r for r in before}, {r.code: r for r in rules}
    dropped = sorted(old.keys() - new.keys())
    weaker = [c for c in old.keys() & new.keys() if old[c].severity == "S0" and new[c] != replace(old[c], value=new[c].value, values=new[c].values)]
    if weaker or any(old[c].severity == "S0" for c in dropped):
        raise ValueError(f"S0 rules can't be dropped or weakened: {sorted(set(weaker) | {c for c in dropped if old[c].severity == 'S0'})}")
    return {"added": sorted(new.keys() - old.keys()), "changed": sorted(c for c in old.keys() & new.keys() if old[c] != new[c]), "dropped": dropped}


# Codes of the ten mandatory rules; the patterns are this library's own defaults, to be replaced by a deployment's.
MANDATORY: tuple[Rule, ...] = (
    Rule("GOV-CONTENT-001", ("question", "gold_answer"), "matches", r"(?i)恐怖袭击|色情|仇恨言论|\bkill (?:him|her|them|you)\b|\bporn"),
    Rule("GOV-CONTENT-002", ("evidence",), "blank", action="refuse"),
    Rule("GOV-FAIRNESS-001", ("question", "gold_answer"), "matches", r"(?i)(?:女性|男性|农村人|老年人|外地人)(?:不适合|不配|不如)|\b(?:women|men|foreigners) (?:can't|cannot|should not)\b", action="regenerate"),
    Rule("GOV-PII-001", ("question", "gold_answer"), "matches", r"(?<!\d)1[3-9]\d{9}(?!\d)|(?<!\d)\d{17}[\dXx](?!\d)|[\w.+-]+@[\w-]+\.[\w.]+", action="mask"),
    Rule("GOV-PII-002", ("evidence",), "matches", r"(?<!\d)\d{17}[\dXx](?!\d)|(?<!\d)\d{16,19}(?!\d)", action="keep local"),
    Rule("GOV-SECRET-001", ("question", "gold_answer", "evidence"), "matches", r"(?i)(?:api[_ -]?key|access[_ -]?token|password|密钥|口令)\s*[:=：]\s*\S+", action="remove"),
    Rule("GOV-GROUND-001", ("grounded",), "among", values=("false",), action="revise"),
    Rule("GOV-INJECT-001", ("question", "evidence"), "matches", r"(?i)ignore (?:all |the )?(?:previous|above) instructions|忽略(?:以上|之前)(?:的)?(?:所有)?指令", action="ignore"),
    Rule("GOV-SCOPE-001", ("in_corpus",), "among", values=("false",), action="stop"),
    Rule("GOV-VERSION-001", ("version_state",), "outside", values=("current", "marked"), action="mark"),
)

#: Further dimensions of quality that one case shows; they warn and don't block. What several cases show is below.
QUALITY: tuple[Rule, ...] = (
    Rule("QA-CLARITY", ("question",), "lacks", r"(?U)^\s*\S.{3,200}$", severity="S2", action="warn"),
    Rule("QA-MATCH", ("gold_answer",), "sql", "gold_answer = question", severity="S2", action="warn"),
    Rule("QA-POINTS", ("gold_answer",), "blank", severity="S2", action="warn"),
    Rule("QA-CONCISE", ("gold_answer",), "sql", "length(gold_answer) > 60 AND gold_answer = evidence", severity="S2", action="warn"),
    Rule("QA-OBJECTIVE", ("question",), "matches", r"(?i)你认为|您觉得|谈谈看法|\bdo you (?:think|feel|like)\b|\bin your opinion\b", severity="S2", action="warn"),
)


def contradictions(cases: DataFrame, by: str = "document_id") -> DataFrame:
    """(by, key, answers, cases): questions that a document answers in more than one way, by the keys of questions and answers."""
    keyed = cases.select(by, question_key(F.col("question")).alias("key"), answer_key(F.col("gold_answer")).alias("answer")).where("key <> ''")
    return keyed.groupBy(by, "key").agg(F.countDistinct("answer").alias("answers"), F.count(F.lit(1)).alias("cases")).where("answers > 1")


def balance(cases: DataFrame, by: str = "document_id", kind: str = "kind") -> DataFrame:
    """(by, cases, kinds, largest, evenness): the share of a document's most frequent type, and the entropy of its types as a part of the most there could be; 1 for a single type."""
    counts = cases.groupBy(by, F.coalesce(kind, F.lit("none")).alias("_kind")).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n")
    entropy = F.log(total) - F.sum(F.col("_n") * F.log("_n")) / total
    out = counts.groupBy(by).agg(total.alias("cases"), F.count(F.lit(1)).alias("kinds"), F.round(F.max("_n") / total, 6).alias("largest"), entropy.alias("_e"))
    return out.select(by, "cases", "kinds", "largest", F.when(F.col("kinds") == 1, 1.0).otherwise(F.round(F.col("_e") / F.log("kinds"), 6)).alias("evenness"))
