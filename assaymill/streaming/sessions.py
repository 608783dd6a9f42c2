"""Evaluation results as a stream: sliding and session windows, first arrivals, and confirmations that expire.

Each function takes a stream or a table. On a table it gives what the stream gives once all rows are there, as long as
none came later than ``late``; of a stream, rows that come later than that are dropped, and state goes with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assaymill import schemas as S

#: Seconds for which a confirmation can be used.
CONFIRM_SECONDS = 600
REASONS = ("accepted", "unknown", "expired", "other document", "other content")


def _passed() -> Column:
    return F.count_if(F.coalesce(F.col("score") >= S.PASS_SCORE, F.lit(False))).alias("passed")


def _timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """Event times as time stamps with a watermark; rows without one are nowhere in time and go."""
    out = rows.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())
    return out.withWatermark(time, late) if rows.isStreaming else out


def passes_sliding(results: DataFrame, time: str = "ts", window: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, dimension, total, passed): each result counts in every window that covers it; without a dimension under ``none``."""
    key = F.coalesce("dimension", F.lit("none")).alias("dimension")
    grouped = _timed(results, time, late).groupBy(F.window(time, window, slide).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("total"), _passed()).select(F.col("w.start").alias("start"), "dimension", "total", "passed")


def run_sessions(results: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: str = "run_id") -> DataFrame:
    """(by, start, end, total, passed): the stretches of each run without a pause of ``gap`` or more; ``end`` is when the pause is over.

    Late rows may join two sessions into one as long as the watermark hasn't closed them. Rows without a run are one run.
    """
    grouped = _timed(results, time, late).groupBy(F.session_window(time, gap).alias("w"), by)
    return grouped.agg(F.count(F.lit(1)).alias("total"), _passed()).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "passed")


def first_arrivals(results: DataFrame, key: list[str], time: str = "ts", within: str = "1 hour") -> DataFrame:
    """One row of each key: of a stream the first to come, and none that follows it within that time of the watermark, so
    that keys don't stay for ever; of a table the earliest, ties by all columns."""
    if results.isStreaming:
        return _timed(results, time, within).dropDuplicatesWithinWatermark(key)
    rows = _timed(results, time, within)
    order = [F.col(time), F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")])]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


class _Confirmation(StatefulProcessor):
    """One token: what it was issued for, until it is used or a timer ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.issued = handle.getValueState("issued", "document_id long, file_hash string, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out, some = [], pd.concat(list(rows), ignore_index=True).sort_values(["at", "action"], kind="stable")  # issues before uses
        for row in some.itertuples(index=False):
            if row.action == "issue":
                self._clear()
                self.issued.update((int(row.document_id), row.file_hash, int(row.at)))
                self.handle.registerTimer(int(row.at) + CONFIRM_SECONDS * 1000)
            elif row.action == "use":
                known = self.issued.get() if self.issued.exists() else None
                self._clear()
                out.append((key[0], pd.Timestamp(row.at, unit="ms", tz="UTC"), _outcome(known, row)))
        yield pd.DataFrame(out, columns=["token", "ts", "outcome"])

    def _clear(self) -> None:
        if self.issued.exists():
            self.handle.deleteTimer(int(self.issued.get()[2]) + CONFIRM_SECONDS * 1000)
            self.issued.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.issued.clear()
        yield pd.DataFrame(columns=["token", "ts", "outcome"])

    def close(self) -> None:
        pass


def _outcome(known: Any, row: Any) -> str:
    if known is None:
        return "unknown"
    if row.at - known[2] > CONFIRM_SECONDS * 1000:
        return "expired"
    return "other document" if known[0] != row.document_id else "other content" if known[1] != row.file_hash else "accepted"


def confirmations(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """(token, ts, outcome) of each use of a confirmation token; ``events``: (token, action, document_id, file_hash, ts).

    A token is issued for a document and a content, can be used once, and for 600 seconds. A use finds it ``accepted``,
    ``unknown`` (never issued, used before, or its time over and forgotten), ``expired``, or issued for something else; in each
    case the token is spent. A timer drops tokens that nobody uses once the watermark has passed their time, so state holds
    those of the last minutes. A table gives ``expired`` where a stream may have forgotten the token already.

    Events without a token, a time or a known action are left out; issues come before uses of the same time.
    """
    fit = F.col("token").isNotNull() & F.col("action").isin("issue", "use")
    rows = _timed(events, "ts", late).where(fit).withColumns({"document_id": F.coalesce("document_id", F.lit(-1).cast("long")), "file_hash": F.coalesce("file_hash", F.lit(""))})
    if events.isStreaming:
        timed = rows.select("token", "action", "document_id", "file_hash", F.unix_millis("ts").alias("at"), "ts")
        return timed.groupBy("token").transformWithStateInPandas(_Confirmation(), "token string, ts timestamp, outcome string", outputMode="Append", timeMode="EventTime")
    order = Window.partitionBy("token").orderBy("ts", F.col("action"), "document_id", "file_hash")
    before = lambda c: F.lag(c).over(order)  # noqa: E731  the last event counts only if it is an issue
    used = rows.withColumns({"was": before("action"), "doc": before("document_id"), "hash": before("file_hash"), "at": before("ts")}).where("action = 'use'")
    outcome = (
        F.when(F.coalesce(F.col("was") != "issue", F.lit(True)), "unknown").when(F.unix_millis("ts") - F.unix_millis("at") > CONFIRM_SECONDS * 1000, "expired")
        .when(F.col("doc") != F.col("document_id"), "other document").when(F.col("hash") != F.col("file_hash"), "other content").otherwise("accepted")
    )
    return used.select("token", "ts", outcome.alias("outcome"))
