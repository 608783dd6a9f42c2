"""Versions as a whole: why nothing can be frozen, the gate on the coverage, the version row, its cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.functions.records import utc_now
from assaymill.functions.scoring import next_version
from assaymill.operators.cases import empty_reason, freeze
from assaymill.operators.coverage import active, covered_ids, report


@dataclass
class Release:
    """What a freeze writes. ``report`` is written even where the gate fails; the rest is empty then, and ``refused`` says why."""

    report: DataFrame
    version: DataFrame
    cases: DataFrame
    refused: DataFrame


def release(
    eiu: DataFrame, blocks: DataFrame, documents: DataFrame, cases: DataFrame, versions: DataFrame, document_ids: list[int] | None = None, created_by: str | None = None
) -> Release:
    """A new version of the publishable cases of the chosen documents; the gate and the coverage look at all of them.

    ``versions``: (version_id, version_number). Nothing is frozen where there is nothing to freeze or the gate fails.
    """
    known = active(eiu, blocks, documents)
    row = report(known, blocks, documents, covered_ids(cases)).withColumn("created_at", utc_now())
    latest = versions.agg(F.max_by("version_number", "version_id").alias("latest"), (F.coalesce(F.max("version_id"), F.lit(0)) + 1).alias("version_id"))
    why = empty_reason(eiu, cases, document_ids).select("reason")
    # one row each
    state = row.select("gate_passed", "failures").join(F.broadcast(why)).withColumn("refused", F.coalesce("reason", F.when(~F.col("gate_passed"), F.concat_ws(",", "failures"))))
    opened = latest.join(F.broadcast(state.where("refused IS NULL").select("gate_passed")))
    number = next_version(F.col("latest"))
    made = opened.select("version_id", number.alias("version_number"), F.lit("frozen").alias("status"), F.lit(created_by).cast("string").alias("created_by"))
    frozen = freeze(cases, None, document_ids).join(F.broadcast(made.select("version_id")))
    frozen = frozen.withColumn("case_uid", F.format_string("case_%04d_%06d", "version_id", "case_id"))
    counted = made.join(F.broadcast(frozen.agg(F.count(F.lit(1)).alias("case_count"))))
    return Release(row, counted, frozen, state.where("refused IS NOT NULL").select("refused"))


def rebuilt(snapshot: DataFrame, cases: DataFrame, version_id: int) -> DataFrame:
    """A version's cases made anew: all it has are retired, and the publishable ones of now follow."""
    old = snapshot.withColumn("retired", F.col("retired") | (F.col("version_id") == version_id))
    return old.unionByName(freeze(cases, version_id).select(snapshot.columns))
