"""Quality checks of cases: the five checks, summaries, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.text import json_list

def parsed_checks(replies: DataFrame) -> DataFrame:
    """(case_id, check_type, passed, reason): all five checks of a reply; missing ones and those that are no boolean fail."""
    items = replies.select("case_id", json_list(F.col("reply"), "struct<check_type:string,passed:string,reason:string>").alias("items"))
    wanted = items.select("case_id", "items", F.explode(F.array(*map(F.lit, S.CHECK_TYPES))).alias("check_type"))
    hit = F.try_element_at(F.filter("items", lambda x: x["check_type"] == F.col("check_type")), F.lit(1))
    rows = wanted.withColumn("hit", hit)
    return rows.select("case_id", "check_type", F.coalesce(F.col("hit.passed") == "true", F.lit(False)).alias("passed"), F.coalesce("hit.reason", F.lit("missing")).alias("reason"))


def by_case(checks: DataFrame) -> DataFrame:
    """(case_id, n_checks, passed, failed_hard, failed_soft, reasons) of each case with checks."""
    bad, hard = ~F.coalesce("passed", F.lit(False)), F.col("check_type").isin(S.HARD_CHECKS)
    return checks.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_checks"), (F.count_if(bad) == 0).alias("passed"), F.count_if(bad & hard).alias("failed_hard"), F.count_if(bad & ~hard).alias("failed_soft"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(bad, F.struct("check_type", "reason")))), lambda x: x["reason"]), ";").alias("reasons"),
    )


def summary(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: live cases, whether checked or not, and of the checked ones how many pass and fail."""
    live = cases.where(F.coalesce("review_status", F.lit("")) != "retired").select("case_id")
    rows = live.join(by_case(checks), "case_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count("n_checks").alias("checked"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"), F.count_if(~F.coalesce("passed", F.lit(True))).alias("failed")
    )


def by_check_type(checks: DataFrame) -> DataFrame:
    ok = F.coalesce("passed", F.lit(False))
    return checks.groupBy("check_type").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def transition(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """Statuses after checking: all pass, only soft failures (a review), or hard ones (``regenerate`` tries other angles)."""
    rows = cases.join(by_case(checks).select("case_id", "passed", "failed_hard"), "case_id")
    status = F.when(F.col("passed"), "quality_verified").otherwise("needs_review")
    tag = F.when(F.col("passed"), None).when(F.col("failed_hard") == 0, "answer_coverage").otherwise("generation_issue")
    return rows.select("case_id", status.alias("review_status"), tag.alias("review_tag"), (~F.col("passed") & (F.col("failed_hard") > 0)).alias("regenerate"))


def regenerated(cases: DataFrame, attempts: DataFrame, checks: DataFrame, most: int = 2) -> DataFrame:
    """The first of at most ``most`` attempts of a case that passes all checks replaces it: (case_id, replaced_by)."""
    good = attempts.where(F.col("attempt") <= most).join(by_case(checks).where("passed").select("case_id"), "case_id", "left_semi")
    best = good.groupBy("origin_id").agg(F.min_by("case_id", "attempt").alias("replaced_by"))
    return cases.select("case_id").join(best.withColumnRenamed("origin_id", "case_id"), "case_id")


def checks_of(checks: DataFrame, cases: DataFrame, document_id: int | None = None) -> DataFrame:
    """Checks of live cases, of one document where it is given."""
    live = cases.where(F.coalesce("review_status", F.lit("")) != "retired")
    live = live if document_id is None else live.where(F.col("document_id") == document_id)
    return checks.join(live.select("case_id", "document_id"), "case_id")
