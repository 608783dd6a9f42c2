"""Uploaded and public sets, their validation and assessment, and compositions of several sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.scoring import rate
from assaymill.functions.text import answer_key, trimmed
from assaymill.operators.terms import small

TURN = "struct<q:string,a:string,key_turn:boolean,turn_type:string,depends_on_turns:array<int>>"


def given(c: Column) -> Column:
    return trimmed(F.coalesce(c, F.lit(""))) != ""


def lifted(cases: DataFrame) -> DataFrame:
    """Question and answer of the last turn become the case's; cases without turns stay."""
    last = F.try_element_at("turns", F.lit(-1))
    has = F.coalesce(F.size("turns") > 0, F.lit(False))
    return cases.withColumns({"q": F.when(has, last["q"]).otherwise(F.col("q")), "a": F.when(has, last["a"]).otherwise(F.col("a"))})


def case_errors(multi: bool) -> Column:
    """Array of what is wrong with a case of one or several turns."""
    if not multi:
        return F.array_compact(F.array(*[F.when(~given(F.col(c)), F.lit(f"missing {c}")) for c in ("q", "a")]))
    last = F.try_element_at("turns", F.lit(-1))
    none = F.coalesce(F.size("turns") < 1, F.lit(True))
    key_turn = lambda t, i: F.when(
        F.coalesce(t["key_turn"], F.lit(False))
        & (~F.coalesce(t["turn_type"].isin("memory", "coherence"), F.lit(False)) | F.coalesce(F.size(t["depends_on_turns"]) < 1, F.lit(True))),
        F.concat(F.lit("turn "), (i + 1).cast("string"), F.lit(" key_turn")),
    )
    first = F.array(F.when(~given(F.col("session_id")), F.lit("missing session_id")), F.when(none, F.lit("no turns")), F.when(~none & ~(given(last["q"]) & given(last["a"])), F.lit("last turn")))
    return F.array_compact(F.concat(first, F.coalesce(F.transform("turns", key_turn), F.array().cast("array<string>"))))


def validated(cases: DataFrame, multi: bool, most: int = S.MAX_ERRORS) -> DataFrame:
    """(case_id, position, error): errors in order of cases, the first ``most``."""
    rows = cases.select("case_id", F.posexplode(case_errors(multi)).alias("position", "error"))
    return rows.orderBy("case_id", "position").limit(most)


def assessed(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Completeness, valid and duplicate shares, dimensions and missing evidence, over all or by the given columns."""
    keys = by or []
    both = given(F.col("q")) & given(F.col("a"))
    rows = cases.withColumns({"_both": both, "_valid": both & (F.length(trimmed(F.col("q"))) >= 2), "_key": answer_key(F.col("q"))})
    groups = rows.groupBy(*keys, "_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_both").alias("complete"), F.count_if("_valid").alias("valid"), F.count_if(~given(F.col("evidence"))).alias("no_evidence"),
        F.collect_set(F.when(given(F.col("dimension")), trimmed(F.col("dimension")))).alias("dims"),
    )
    total = groups.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("complete"), F.lit(0)).alias("complete"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("_key") != "", F.col("n") - 1)), F.lit(0)).alias("duplicate_count"), F.coalesce(F.sum("no_evidence"), F.lit(0)).alias("no_evidence_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("dims")))).alias("covered_dimensions"),
    )
    whole = F.nullif(F.col("total"), F.lit(0))
    return total.select(
        *keys, "total", rate(F.col("complete"), whole, 0.0).alias("data_completeness_rate"), rate(F.col("duplicate_count"), whole, 0.0).alias("duplicate_question_ratio"),
        rate(F.col("valid"), whole, 0.0).alias("valid_qa_ratio"), "duplicate_count", "no_evidence_count", "covered_dimensions",
    )


def composition_errors(items: DataFrame, versions: DataFrame, uploaded: DataFrame, public: DataFrame) -> DataFrame:
    """(item_pos, error) of items whose source is unknown or whose reference is absent or not frozen."""
    rows = (
        items.join(versions.select("version_id", F.col("status").alias("_v")), "version_id", "left")
        .join(uploaded.select("set_id", F.lit(True).alias("_u")), "set_id", "left")
        .join(public.select("set_id", F.lit(True).alias("_p")), "set_id", "left")
    )
    doc = F.col("source") == "doc_generated"
    error = (
        F.when(~F.coalesce(F.col("source").isin(S.COMPOSITION_SOURCES), F.lit(False)), "unknown source")
        .when(doc & F.col("_v").isNull(), "version not found")
        .when(doc & (F.col("_v") != "frozen"), "version not frozen")
        .when((F.col("source") == "uploaded") & F.col("_u").isNull(), "uploaded set not found")
        .when((F.col("source") == "public") & F.col("_p").isNull(), "public set not found")
    )
    return rows.select("item_pos", error.alias("error")).where("error IS NOT NULL")


def samples(native: DataFrame | None, uploaded: DataFrame | None, public: DataFrame | None) -> DataFrame:
    """Rows of one shape from up to three sources, with ids that tell the source."""
    none = lambda: F.lit(None).cast("string")
    parts = []
    for df, source, prefix, q, a, level, dim, ref in (
        (native, "doc_generated", "doc_", "question", "gold_answer", "difficulty", None, "version_id"),
        (uploaded, "uploaded", "up_", "q", "a", None, "dimension", "set_id"),
        (public, "public", "pub_", "q", "a", None, "dimension", "set_id"),
    ):
        if df is not None:
            parts.append(df.select(
                F.concat(F.lit(prefix), F.col("case_id").cast("string")).alias("case_uid"), F.coalesce(q, F.lit("")).alias("question"), F.col(a).alias("gold_answer"),
                (F.col(level) if level else none()).alias("difficulty"), (F.col(dim) if dim else none()).alias("dimension"), F.lit(source).alias("source"), F.col(ref).cast("long").alias("ref_id"),
            ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def composed(items: DataFrame, rows: DataFrame, distinct_sets: bool = False) -> DataFrame:
    """Samples of each item, in its dimension if it names one. Two items of one source meet each other's samples,
    as their sets are told apart only with ``distinct_sets``. Items that aren't many go to all tasks, for a source's key has all of its samples."""
    ref = F.coalesce("version_id", "set_id").cast("long")
    wanted = items.select("item_pos", F.col("source"), ref.alias("ref_id"), F.nullif(F.col("dimension"), F.lit("")).alias("_dim"))
    if not distinct_sets:
        loading, meeting = small(wanted.select("source", "ref_id", F.col("item_pos").alias("loaded_by"))), small(wanted.select("item_pos", "source", "_dim"))
        loaded = rows.join(loading, ["source", "ref_id"])
        out = loaded.join(meeting, "source")
    else:
        out = rows.join(small(wanted), ["source", "ref_id"])
    return out.where(F.col("_dim").isNull() | (F.col("_dim") == F.col("dimension"))).drop("_dim")


def stored_cases(cases: DataFrame, set_id: int, with_evidence: bool = True) -> DataFrame:
    """Rows of a set as they are kept: texts as strings, whether evidence is absent, and the one status of checked imports."""
    rows = cases.withColumns({"set_id": F.lit(set_id).cast("long"), "q": F.col("q").cast("string"), "a": F.col("a").cast("string"), "review_status": F.lit("quality_checked")})
    return rows.withColumn("no_evidence", F.coalesce(F.length(F.col("evidence").cast("string")), F.lit(0)) == 0) if with_evidence else rows


@dataclass
class Imported:
    """The rows that an import writes; where ``errors`` has any, the other two are empty."""

    errors: DataFrame
    sets: DataFrame
    cases: DataFrame


def _imported(cases: DataFrame, multi: bool, set_id: int, fields: dict, with_evidence: bool) -> Imported:
    errors = validated(cases, multi)
    sound = errors.agg((F.count(F.lit(1)) == 0).alias("_sound")).where("_sound")  # a row or none
    rows = lifted(cases) if multi else cases
    quality = assessed(rows).drop("total")
    made = {c: F.lit(v) for c, v in fields.items()} | {"set_id": F.lit(set_id).cast("long"), "review_status": F.lit("quality_checked")}
    head = assessed(rows).select(F.col("total").alias("total_cases")).join(F.broadcast(quality.select(F.struct(*quality.columns).alias("quality_snapshot")))).withColumns(made)
    return Imported(errors, head.join(F.broadcast(sound)).drop("_sound"), stored_cases(rows, set_id, with_evidence).join(F.broadcast(sound)).drop("_sound"))


def imported_upload(cases: DataFrame, set_id: int, name: str, template: str = "single", dimension: str | None = None, source_file: str | None = None) -> Imported:
    """A set that a user uploads: checked, its last turns lifted, assessed; its row and its cases."""
    if template not in ("single", "multi"):
        raise ValueError(f"unknown template: {template}")
    return _imported(cases, template == "multi", set_id, {"name": name, "template_type": template, "dimension": dimension, "source_file": source_file}, True)


def imported_public(cases: DataFrame, set_id: int, name: str, version: str = "v1.0.0", dimensions: list[str] | None = None) -> Imported:
    """A public set of single turns, whatever status its cases came with."""
    return _imported(cases, False, set_id, {"name": name, "version": version, "dimensions": ",".join(dimensions or []), "status": "active"}, False)


def without_set(sets: DataFrame, cases: DataFrame, set_id: int) -> tuple[DataFrame, DataFrame]:
    """Sets and cases without a set and all of its cases."""
    return sets.where(F.col("set_id") != set_id), cases.where(F.col("set_id") != set_id)


@dataclass
class Composition:
    """The rows that creating a composition writes; where ``errors`` has any, the others are empty."""

    errors: DataFrame
    compositions: DataFrame
    items: DataFrame
    audit: DataFrame


def created(items: DataFrame, composition_id: int, name: str, versions: DataFrame, uploaded: DataFrame, public: DataFrame, created_by: str | None = None) -> Composition:
    """A composition of items whose sources exist and are frozen, with its audit row; otherwise its first errors."""
    errors = composition_errors(items, versions, uploaded, public).orderBy("item_pos").limit(S.MAX_ERRORS)
    sound = errors.agg((F.count(F.lit(1)) == 0).alias("_sound")).where("_sound").drop("_sound")  # a row or none
    head = sound.select(F.lit(composition_id).cast("long").alias("composition_id"), F.lit(name).alias("name"), F.lit(created_by).cast("string").alias("created_by"))
    kept = items.withColumn("composition_id", F.lit(composition_id).cast("long")).join(F.broadcast(head.select("composition_id")), "composition_id", "left_semi")
    counted = head.join(F.broadcast(items.agg(F.count(F.lit(1)).alias("n_items"))))
    audit = counted.select(
        F.lit("composition.create").alias("operation"), F.lit("composition").alias("target_type"), F.col("composition_id").cast("string").alias("target_id"),
        F.coalesce("created_by", F.lit("web")).alias("actor"), F.array(F.lit("items"), F.lit("name")).alias("fields"),
    )
    return Composition(errors, counted, kept, audit)
