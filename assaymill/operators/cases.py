"""Cases: filters, exact dedup, pages, freezing into versions, statistics, patches and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.text import question_key
from assaymill.operators.coverage import publishable
from assaymill.plans.session import checkpoints


def having(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the given values or are among the given lists; None leaves a column alone."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name).isin(value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def filter_statements(eiu: DataFrame, types=None, priorities=None, questionable=None, section=None, document_id=None, include_blocked=False) -> DataFrame:
    out = having(eiu, eiu_type=types, content_priority=priorities, is_questionable=questionable, document_id=document_id)
    out = out if section is None else out.where(F.contains("section_path", F.lit(section)))
    return out if include_blocked else out.where(F.coalesce("review_status", F.lit("")) != "blocked")


def filter_cases(cases: DataFrame, include_retired: bool = False, **wanted) -> DataFrame:
    out = having(cases, **wanted)
    return out if include_retired or wanted.get("review_status") else out.where(F.coalesce("review_status", F.lit("")) != "retired")


def page(df: DataFrame, *order: Column, limit: int = S.PAGE, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def dedup_exact(cases: DataFrame, *order: Column) -> DataFrame:
    """Adds ``kept``: the first of each normalised question, and every case without one; by default the newest."""
    key = question_key(F.col("question"))
    # cases without a key are each on their own, so they don't meet in one task
    part = F.when(key == "", F.concat(F.lit("\0"), F.col("case_id").cast("string"))).otherwise(key)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*(order or (F.col("case_id").desc(),))))
    return cases.withColumn("_part", part).withColumn("kept", (rank == 1) | (key == "")).drop("_part")


def empty_reason(eiu: DataFrame, cases: DataFrame, document_ids: list[int] | None = None) -> DataFrame:
    """Why nothing can be frozen, one row; null where something can."""
    a = eiu.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_questionable").alias("q"))
    b = publishable(cases, document_ids).agg(F.count(F.lit(1)).alias("c"))
    return a.join(F.broadcast(b)).select(F.when(F.col("n") == 0, "no_statement").when(F.col("q") == 0, "no_questionable").when(F.col("c") == 0, "no_publishable_case").alias("reason"))


def freeze(cases: DataFrame, version_id: int | None, document_ids: list[int] | None = None) -> DataFrame:
    """The publishable cases of a version, one of each question, with their ids inside it; without a version neither is set yet."""
    kept = dedup_exact(publishable(cases, document_ids)).where("kept").drop("kept")
    uid = F.format_string("case_%04d_%06d", F.lit(version_id), F.col("case_id"))
    out = kept.withColumns({"source": F.lit("native"), "retired": F.lit(False)})
    return out if version_id is None else out.withColumns({"version_id": F.lit(version_id).cast("long"), "case_uid": uid})


def statistics(cases: DataFrame, *dimensions: str, limit: int | None = S.PAGE, order: str = "case_id") -> DataFrame:
    """(dimension, key, n) over the first ``limit`` cases; None takes all."""
    rows = page(cases, F.col(order), limit=limit) if limit else cases
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("unknown")).alias("key")) for d in dimensions])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).alias("n"))


def pending(eiu: DataFrame, cases: DataFrame) -> DataFrame:
    """Questionable statements without any live case, whatever its status."""
    return eiu.where("is_questionable").join(cases.where(F.coalesce("review_status", F.lit("")) != "retired"), "eiu_id", "left_anti")


def patched(df: DataFrame, patches: DataFrame, key: str, nullable: tuple[str, ...] = ()) -> DataFrame:
    """Columns of matching patches replace those of ``df`` where not null; ``set_null`` names may be cleared."""
    names = [c for c in patches.columns if c not in (key, "set_null")]
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in names], *(["set_null"] if nullable else []))
    out = df.join(p, key, "left")
    clear = lambda c: F.coalesce(F.array_contains("set_null", c), F.lit(False))
    new = {c: F.when(clear(c), None).otherwise(F.coalesce(f"_{c}", c)) if c in nullable else F.coalesce(f"_{c}", c) for c in names}
    return out.withColumns(new).select(df.columns)


def retired(cases: DataFrame, keys: DataFrame, key: str = "case_id") -> DataFrame:
    hit = F.coalesce("_hit", F.lit(False))
    out = cases.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return out.withColumn("review_status", F.when(hit, "retired").otherwise(F.col("review_status"))).select(cases.columns)


def blocked(eiu: DataFrame, keys: DataFrame) -> DataFrame:
    """Deleted statements stay, blocked and no longer questionable."""
    hit = F.coalesce("_hit", F.lit(False))
    out = eiu.join(keys.select("eiu_id").distinct().withColumn("_hit", F.lit(True)), "eiu_id", "left")
    new = {"review_status": F.when(hit, "blocked").otherwise(F.col("review_status")), "is_questionable": F.col("is_questionable") & ~hit}
    return out.withColumns(new).select(eiu.columns)


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def without_document(document_id: int, documents: DataFrame, blocks: DataFrame, eiu: DataFrame, cases: DataFrame, checks: DataFrame) -> list[DataFrame]:
    """The five tables without a document and all that hangs on it."""
    gone = F.col("document_id") == document_id
    return [
        documents.where(~gone), blocks.where(~gone), without(eiu, blocks.where(gone), "block_id"),
        cases.where(~F.coalesce(gone, F.lit(False))), without(checks, cases.where(gone), "case_id"),
    ]


def replaced_checks(checks: DataFrame, new: DataFrame) -> DataFrame:
    """All checks of the cases in ``new`` give way to its rows."""
    return without(checks, new.select("case_id").distinct(), "case_id").unionByName(new)


def numbered(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """A dense number in order from 1, without all rows in one task; rows that tie are numbered in any order.

    Rows are dealt into ordered ranges and written once, so that counts and numbers see the same ranges.
    """
    spark = df.sparkSession
    checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = "_tie"  # parts the rows of one key as well
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    kept = dealt.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    kept = kept.withColumns({"_p": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each partition
    return kept.join(F.broadcast(base), "_p").withColumn(key, (F.col("_b") + F.col("_i") + 1).cast("long")).drop("_p", "_i", "_b", "_at")


def inserted_statements(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """New statements: the first of each block and text, weight by priority, evidence and document from the block.

    ``problem`` names rows that must not be written: excluded ones without a reason.
    """
    first = F.row_number().over(Window.partitionBy("block_id", "statement").orderBy("position")) == 1
    out = items.withColumn("_first", first).where("_first").drop("_first")
    weights = [F.when(F.col("content_priority") == p, w) for p, w in S.PRIORITY_WEIGHT.items()]
    out = out.join(blocks.select("block_id", "document_id"), "block_id", "left")
    no_reason = ~F.col("is_questionable") & (F.coalesce("exclusion_reason", F.lit("")) == "")
    return out.withColumns({
        "weight": F.coalesce(*weights, F.lit(1)), "evidence_blocks": F.coalesce("evidence_blocks", F.array("block_id")),
        "problem": F.when(no_reason, "excluded without a reason"),
    })


def revised(cases: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, audit): revised cases return to candidate without a tag; retired ones are not touched."""
    live = patches.join(cases.where("review_status <> 'retired'").select("case_id"), "case_id", "left_semi")
    out = patched(cases, live.withColumn("review_status", F.lit("candidate")), "case_id")
    tag = F.coalesce("_hit", F.lit(False))
    out = out.join(live.select("case_id", F.lit(True).alias("_hit")), "case_id", "left").withColumn("review_tag", F.when(~tag, F.col("review_tag"))).select(cases.columns)
    names = [c for c in patches.columns if c != "case_id"]
    changed = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])))
    return out, live.select(F.col("case_id").cast("string").alias("target_id"), F.lit("dataset_case.revise").alias("operation"), changed.alias("changed_fields"))

