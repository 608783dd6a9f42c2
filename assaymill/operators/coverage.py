"""Coverage of testable statements by cases: totals, breakdowns, gaps, reconciliation, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.scoring import rate, weight_of


def active(eiu: DataFrame, blocks: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Statements that are not blocked; with blocks and documents given, those whose both exist, with their names."""
    out = eiu.where(F.coalesce("review_status", F.lit("")) != "blocked")
    if blocks is not None:
        out = out.drop("document_id").join(blocks.select("block_id", "document_id", "section_path"), "block_id")
    if documents is not None:
        out = out.join(documents.select("document_id", F.col("file_name").alias("document_name")), "document_id")
    return out


def publishable(cases: DataFrame, document_ids: list[int] | None = None) -> DataFrame:
    out = cases.where(F.col("review_status").isin(S.PUBLISHABLE))
    return out.where(F.col("document_id").isin(document_ids)) if document_ids else out


def covered_ids(cases: DataFrame, statuses: list[str] | None = None, document_ids: list[int] | None = None) -> DataFrame:
    """Distinct statements that have a case, by default one that can be published."""
    out = cases.where(F.col("review_status").isin(statuses or S.PUBLISHABLE) & F.col("eiu_id").isNotNull())
    return (out.where(F.col("document_id").isin(document_ids)) if document_ids else out).select("eiu_id").distinct()


def with_covered(eiu: DataFrame, covered: DataFrame) -> DataFrame:
    return eiu.join(covered.withColumn("covered", F.lit(True)), "eiu_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def gaps(eiu: DataFrame, covered: DataFrame) -> DataFrame:
    """Questionable statements without a case."""
    return eiu.where("is_questionable").join(covered, "eiu_id", "left_anti").withColumn("reason", F.lit("暂无对应题目"))


def totals(eiu: DataFrame) -> DataFrame:
    return eiu.agg(
        F.count(F.lit(1)).alias("total_eiu"),
        F.count_if(F.col("is_questionable")).alias("questionable_eiu"),
        F.count_if(~F.col("is_questionable")).alias("excluded_eiu"),
    )


def by_priority(eiu: DataFrame) -> DataFrame:
    """P0 to P2, with 0 where there is none; other priorities are dropped."""
    counts = eiu.agg(*[F.count_if(F.col("content_priority") == p).alias(p) for p in S.PRIORITY_WEIGHT])
    return counts.unpivot([], list(S.PRIORITY_WEIGHT), "content_priority", "eiu_count")


def by_type(eiu: DataFrame) -> DataFrame:
    return eiu.groupBy("eiu_type").agg(F.count(F.lit(1)).alias("eiu_count"))


def by_document(eiu: DataFrame, documents: DataFrame) -> DataFrame:
    counts = eiu.where("document_id IS NOT NULL").groupBy("document_id").agg(F.count(F.lit(1)).alias("eiu_count"))
    return counts.join(documents.select("document_id", F.col("file_name").alias("document_name")), "document_id", "left")


def by_section(eiu: DataFrame) -> DataFrame:
    some = eiu.where(F.coalesce("section_path", F.lit("")) != "")
    return some.groupBy("section_path").agg(F.count(F.lit(1)).alias("eiu_count"))


def weighted(eiu: DataFrame, covered: DataFrame) -> DataFrame:
    """Weighted and P0 coverage over questionable statements, one row; without any 0 and 1."""
    rows = with_covered(eiu.where("is_questionable"), covered).withColumn("w", weight_of(F.col("weight"), F.col("content_priority")).cast("long"))
    p0 = F.col("content_priority") == "P0"
    sums = rows.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("total_weight"),
        F.coalesce(F.sum(F.when(F.col("covered"), F.col("w"))), F.lit(0)).alias("covered_weight"),
        F.count_if(p0).alias("p0_total"),
        F.count_if(p0 & F.col("covered")).alias("p0_covered"),
    )
    return sums.withColumns({
        "weighted_coverage": rate(F.col("covered_weight"), F.nullif(F.col("total_weight"), F.lit(0)), 0.0),
        "p0_coverage_pct": rate(F.col("p0_covered"), F.nullif(F.col("p0_total"), F.lit(0)), 1.0),
    })


def uncovered_blocks(eiu: DataFrame, blocks: DataFrame) -> DataFrame:
    return blocks.where("block_type <> 'title'").join(eiu.select("block_id").distinct(), "block_id", "left_anti").select("block_id", "section_path")


def reconciliation(eiu: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct blocks with a statement over blocks that are no titles; may exceed 1, as titles may have statements."""
    a = blocks.agg(F.count_if(F.col("block_type") != "title").alias("total_paragraph_blocks"))
    b = eiu.agg(F.countDistinct("block_id").alias("covered_blocks"))
    whole = F.nullif(F.col("total_paragraph_blocks"), F.lit(0))
    return a.join(F.broadcast(b)).withColumn("rate", rate(F.col("covered_blocks"), whole, 1.0))  # one row each


def alerts(eiu: DataFrame, blocks: DataFrame) -> DataFrame:
    """Warnings that the coverage may be distorted, in fixed order; one row with an array."""
    bad = ~F.col("is_questionable") & F.coalesce(F.contains("exclusion_reason", F.lit("难生成")) | F.contains("exclusion_reason", F.lit("难出题")), F.lit(False))
    sums = eiu.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_questionable")).alias("out"),
        F.min(F.when(bad, F.col("eiu_id"))).alias("bad_id"), F.min_by(F.when(bad, F.col("exclusion_reason")), F.when(bad, F.col("eiu_id"))).alias("bad_reason"),
    )
    left = uncovered_blocks(eiu, blocks).agg(F.count(F.lit(1)).alias("uncovered"))
    row = sums.join(F.broadcast(reconciliation(eiu, blocks))).join(F.broadcast(left))  # one row each
    share, exact = F.try_divide(F.col("out"), F.col("n")), F.try_divide(F.col("covered_blocks"), F.col("total_paragraph_blocks"))
    percent = lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
    return row.select(F.array_compact(F.array(
        F.when(share > 0.5, F.concat(F.lit("排除记录占比 "), percent(share), F.lit(" 超过 50%，疑似覆盖率分母被人为排空，请检查 exclusion_reason"))),
        F.when(F.col("bad_id").isNotNull(), F.concat(F.lit("EIU "), F.col("bad_id").cast("string"), F.lit(" 的排除原因不合理（"), F.col("bad_reason"), F.lit("），不得因'题目难生成'排除"))),
        F.when(exact < 1, F.concat(F.lit("实质 Block 对账率 "), percent(exact), F.lit(" < 100%，有 "), F.col("uncovered").cast("string"), F.lit(" 个段落未生成 EIU 或排除记录"))),
    )).alias("alerts"))


def gate(weighted_coverage: Column, p0: Column, blocks: Column) -> list[Column]:
    """(gate_passed, failures) of a report's three rates; a rate that is null isn't judged."""
    failures = F.array_compact(F.array(
        F.when(weighted_coverage < S.GATE_WEIGHTED, F.lit("weighted_coverage")), F.when(p0 < S.GATE_P0, F.lit("p0_coverage")), F.when(blocks < S.GATE_BLOCKS, F.lit("reconciliation")),
    ))
    return [(F.size(failures) == 0).alias("gate_passed"), failures.alias("failures")]


def report(eiu: DataFrame, blocks: DataFrame, documents: DataFrame, covered: DataFrame) -> DataFrame:
    """The whole report as one nested row."""
    listed = lambda df, name, *order: df.agg(F.sort_array(F.collect_list(F.struct(*order))).alias(name))
    row = totals(eiu).join(F.broadcast(weighted(eiu, covered))).join(F.broadcast(reconciliation(eiu, blocks)))
    for part in (
        listed(by_priority(eiu), "by_priority", "content_priority", "eiu_count"),
        listed(by_type(eiu), "by_type", "eiu_type", "eiu_count"),
        listed(by_document(eiu, documents), "by_document", "document_id", "document_name", "eiu_count"),
        listed(by_section(eiu).withColumn("order", -F.col("eiu_count")), "by_section", "order", "section_path", "eiu_count"),
        alerts(eiu, blocks),
    ):
        row = row.join(F.broadcast(part))  # one row each
    return row.withColumns(dict(zip(("gate_passed", "failures"), gate(F.col("weighted_coverage"), F.col("p0_coverage_pct"), F.col("rate")), strict=True)))


def section_tree(eiu: DataFrame, cases: DataFrame) -> DataFrame:
    """A row per section: statements, cases, coverage in per cent, gap, and cases by document."""
    known = eiu.select("eiu_id", "is_questionable", F.coalesce(F.nullif(F.col("section_path"), F.lit("")), F.lit(S.UNFILED)).alias("section_path"), F.coalesce("document_name", F.lit(S.NO_DOCUMENT)).alias("document_name"))
    rows = with_covered(known, cases.where("eiu_id IS NOT NULL").select("eiu_id").distinct())
    statements = rows.groupBy("section_path").agg(
        F.count(F.lit(1)).alias("eiu_count"), F.count_if("is_questionable").alias("questionable"), F.count_if(F.col("is_questionable") & F.col("covered")).alias("covered_eiu")
    )
    placed = cases.select("eiu_id").join(known.select("eiu_id", "section_path", "document_name"), "eiu_id", "left").select(
        F.coalesce("section_path", F.lit(S.UNFILED)).alias("section_path"), F.coalesce("document_name", F.lit(S.NO_DOCUMENT)).alias("document_name"), F.lit(1).alias("n")
    )
    documents = placed.unionByName(known.select("section_path", "document_name", F.lit(0).alias("n"))).groupBy("section_path", "document_name").agg(F.sum("n").alias("n"))
    per = documents.groupBy("section_path").agg(F.sum("n").alias("case_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("document_name", "n")))).alias("documents"))
    out = per.join(statements, "section_path", "left").fillna(0, ["eiu_count", "questionable", "covered_eiu"])
    percent = F.round(F.coalesce(F.try_divide(F.col("covered_eiu") * 100.0, F.col("questionable")), F.lit(0.0)), 1)
    return out.select("section_path", "eiu_count", "case_count", percent.alias("coverage_pct"), F.greatest(F.col("questionable") - F.col("covered_eiu"), F.lit(0)).alias("gap"), "documents")
