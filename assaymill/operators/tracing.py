"""Whether evidence can be traced: quoted spans against the blocks of their document, by position and by text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaymill.functions.scoring import rate

#: Characters of a document that one key of the join stands for.
BIN = 4096


def overlaps(quotes: DataFrame, blocks: DataFrame, size: int = BIN) -> DataFrame:
    """(quote_id, block_id, start, end): what each quote shares with each block of its document, in characters.

    ``quotes``: (quote_id, document_id, start, end), ``blocks``: (block_id, document_id, start, end), ends exclusive. Both are
    cut at multiples of ``size``, so a join's key is a stretch of a document and never a document; a pair counts in the
    stretch where its overlap begins, once. Spans that are empty, negative or null share nothing.
    """

    def binned(rows: DataFrame, key: str, side: str) -> DataFrame:
        fit = rows.where("document_id IS NOT NULL AND start >= 0 AND end > start")
        bins = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("bin")
        return fit.select(key, "document_id", F.col("start").alias(f"start_{side}"), F.col("end").alias(f"end_{side}"), bins)

    q, b = binned(quotes, "quote_id", "q"), binned(blocks, "block_id", "b")
    start, end = F.greatest("start_q", "start_b"), F.least("end_q", "end_b")
    both = q.join(b, ["document_id", "bin"]).where((start < end) & (F.floor(start / size) == F.col("bin")))
    return both.select("quote_id", "block_id", start.alias("start"), end.alias("end"))


def traced(quotes: DataFrame, blocks: DataFrame, size: int = BIN) -> DataFrame:
    """Adds to each quote ``n_blocks``, ``covered`` (its characters that lie in some block), ``gaps`` (stretches that don't) and ``status``.

    ``traced``: all of it lies in blocks; ``partial``: some; ``lost``: none; ``unlocated``: it has no valid place. Blocks may
    overlap each other: characters count once. Quote ids must not repeat.
    """
    found = overlaps(quotes, blocks, size)
    order = Window.partitionBy("quote_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(reach, F.col("start"))), F.lit(0))
    broken = (reach.isNotNull() & (F.col("start") > reach)).cast("int")
    sums = found.withColumns({"new": new, "broken": broken}).groupBy("quote_id").agg(
        F.countDistinct("block_id").alias("n_blocks"), F.sum("new").alias("covered"), F.sum("broken").alias("inner"), F.min("start").alias("first"), F.max("end").alias("last")
    )
    rows = quotes.join(sums, "quote_id", "left")
    placed = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & F.col("document_id").isNotNull(), F.lit(False))
    edges = (F.col("first") > F.col("start")).cast("int") + (F.col("last") < F.col("end")).cast("int")
    n, covered = F.coalesce("n_blocks", F.lit(0)).cast("long"), F.coalesce("covered", F.lit(0)).cast("long")
    gaps = F.when(~placed, 0).when(covered == 0, 1).otherwise(F.col("inner") + edges).cast("long")
    status = F.when(~placed, "unlocated").when(covered == 0, "lost").when(covered == F.col("end") - F.col("start"), "traced").otherwise("partial")
    return rows.select(*[quotes[c] for c in quotes.columns], n.alias("n_blocks"), covered.alias("covered"), gaps.alias("gaps"), status.alias("status"))


def faithful(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``faithful`` to quotes with ``quote``: whether the document (document_id, text) has just this text at this place; null without document or place.

    Quotes of a document go to its text as one list of places, so a text is read once; quotes of very much quoted
    documents are dealt to copies of it.
    """
    share = F.pmod(F.xxhash64("quote_id"), F.col("_copies"))
    counts = quotes.groupBy("document_id").agg(F.ceil(F.count(F.lit(1)) / 10_000).alias("_copies"))
    dealt = quotes.join(counts, "document_id").withColumn("_copy", share)
    texts = documents.select("document_id", "text").join(counts, "document_id").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).drop("_copies")
    there = dealt.join(texts, ["document_id", "_copy"])
    same = F.when((F.col("start") >= 0) & (F.col("end") >= F.col("start")), F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")) == F.col("quote"))
    return quotes.join(there.select("quote_id", same.alias("faithful")), "quote_id", "left")


def trace_rates(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., quotes, traced, partial, lost, unlocated, traceability) of ``traced``; the rate is of fully traced quotes."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    sums = found.groupBy(*by).agg(F.count(F.lit(1)).alias("quotes"), *[count(s) for s in ("traced", "partial", "lost", "unlocated")])
    return sums.withColumn("traceability", rate(F.col("traced"), F.nullif(F.col("quotes"), F.lit(0)), None))


def association(blocks: DataFrame, eiu: DataFrame) -> DataFrame:
    """(paragraphs, associated, association_rate, statements, excluded, exclusion_rate): how many paragraphs have a statement, and how many statements aren't asked about."""
    own = eiu.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    sides = blocks.where("block_type = 'paragraph'").join(own, "block_id", "left").agg(F.count(F.lit(1)).alias("paragraphs"), F.count("n").alias("associated"))
    sums = eiu.agg(F.count(F.lit(1)).alias("statements"), F.count_if(~F.coalesce("is_questionable", F.lit(True))).alias("excluded"))
    both = sides.join(F.broadcast(sums))  # one row each
    return both.select(
        "paragraphs", "associated", rate(F.col("associated"), F.nullif(F.col("paragraphs"), F.lit(0)), None).alias("association_rate"), "statements", "excluded",
        rate(F.col("excluded"), F.nullif(F.col("statements"), F.lit(0)), None).alias("exclusion_rate"),
    )
