"""Mixing sources to target weights: fixed blocks of words, multinomial counts of each shard, permuted blocks joined by index.

Every source is one long stream of words, its documents one after the other, cut into blocks. The mix is a row of
slots, each of which takes one block; shards of slots draw from which sources they come. Everything is DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, run_folder, small_or_joined, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of a shard.
BLOCK, SHARD = 256, 65_536
#: Rounds of the permutation of a source's blocks.
ROUNDS = 24
#: Documents that are numbered in one group, about.
GROUP = 4_000
#: Cells of the slots' number range, by which draws find their source.
CELLS = 1024


class Mixture(NamedTuple):
    """(source, src, words, target, ...), a row a source; (key, src, size, start), a row a document; slots."""

    sources: DataFrame
    layout: DataFrame
    slots: DataFrame


def targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, src, words, target): a source's number, words and target, from rows (source, size).

    Sources by code point, null last, have the weights in turn. Targets share ``share`` of all words by weight; where
    that is above ``most`` times a source's words it stops there, and the others share the rest in the same way. The
    sources where it stops are those of the fewest words a weight, so one pass in that order finds the level.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"))
    every = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(every).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    full = totals.select("source", "words", rank.alias("src"), weight.alias("weight"), (F.col("words") * float(most)).alias("full"))
    filling = Window.orderBy(F.col("full") / F.col("weight"), "src")
    stopped = F.coalesce(F.sum("full").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sharing = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("words").over(Window.partitionBy()) * float(share) - stopped) / sharing
    levels = full.withColumns({"at": F.row_number().over(filling), "level": level})
    free = F.min(F.when(F.col("level") < F.col("full") / F.col("weight"), F.struct("at", "level"))).over(Window.partitionBy())
    return levels.select("source", "src", "words", F.least(F.col("weight") * free["level"], "full").alias("target"))


def quotas(sources: DataFrame, block: int) -> DataFrame:
    """Adds what a source gives: whole ``blocks``, words of its ``tail``, ``passes`` over all of it, words in the ``rest`` of a pass, slots ``n``."""
    words = F.greatest("words", F.lit(1))
    quota = F.round("target").cast("long")
    out = sources.withColumns({"blocks": F.floor(F.col("words") / block), "tail": F.col("words") % block, "passes": F.floor(quota / words), "rest": quota % words})
    per_pass = F.col("blocks") + (F.col("tail") > 0).cast("long")
    return out.withColumns({"per_pass": per_pass, "n": F.col("passes") * per_pass + F.ceil(F.col("rest") / block)})


def permuted(i: Column, size: Column, *keys: Column) -> Column:
    """The place of ``i`` in a pseudorandom permutation of 0 to size - 1 that the keys choose, by swap-or-not rounds.

    A round pairs each number with another and swaps the pair or not, by a hash of the pair; so every size is a
    permutation, without tables, sorting or trying again.
    """
    size = F.greatest(size, F.lit(1).cast("long"))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), size) - x, size)
        swap = F.xxhash64(*keys, r, F.greatest(x, other)).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), i, step)


def shard_counts(spark: SparkSession, sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, src, from, n): the slots of each shard that each source fills, numbered on from shard to shard.

    Each slot of a shard draws its source with the chance of the source's share of all slots, so a shard's counts are
    multinomial. Sources that shards drew more often than their target wants give no more from there on; what the
    others lack then makes up one more shard, so that the mix meets its targets and the noise stays within shards.
    """
    total = sources.agg(F.sum("n")).first()[0] or 0
    width = -(-total // CELLS) or 1
    before = F.coalesce(F.sum("n").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ranges = sources.where("n > 0").select("src", before.alias("low"), (before + F.col("n")).alias("high"))
    cells = stored(ranges.select("*", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell")), "cells")
    number = F.floor(F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), "id"), 11) / float(2**53) * total)
    draws = spark.range(total).select(F.floor(F.col("id") / shard).alias("shard"), number.alias("number")).withColumn("cell", F.floor(F.col("number") / width))
    drawn = draws.join(small_or_joined(cells), "cell").where("number >= low AND number < high")
    counts = stored(drawn.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("drawn")), "counts")
    earlier = F.coalesce(F.sum("drawn").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    wanted = sources.select("src", F.col("n").alias("wanted"))
    some = counts.withColumn("from", earlier).join(small_or_joined(wanted), "src")
    some = some.select("shard", "src", "from", F.least("drawn", F.col("wanted") - F.col("from")).alias("n"))
    given = wanted.join(counts.groupBy("src").agg(F.sum("drawn").alias("given")), "src", "left").fillna(0, ["given"])
    last = given.select(F.lit(-(-total // shard)).cast("long").alias("shard"), "src", F.col("given").alias("from"), (F.col("wanted") - F.col("given")).alias("n"))
    return some.unionByName(last).where("n > 0")


def slots_of(counts: DataFrame, sources: DataFrame, block: int, seed: int) -> DataFrame:
    """(shard, src, slot, index, n_words): the block that each slot takes, and how many of its first words.

    A source goes through its blocks in a permuted order, another one each pass; its tail, shorter than a block, comes
    last, and only the very last slot is cut. No block comes more often than there are passes begun.
    """
    each = counts.select("shard", "src", F.explode(F.sequence("from", F.col("from") + F.col("n") - 1)).alias("slot"))
    each = each.join(small_or_joined(sources.select("src", "blocks", "tail", "passes", "rest", "per_pass")), "src")
    each = each.withColumns({"lap": F.floor(F.col("slot") / F.col("per_pass")), "i": F.col("slot") % F.col("per_pass")})
    whole = F.col("i") < F.col("blocks")
    index = F.when(whole, permuted(F.col("i"), F.col("blocks"), F.lit(seed).cast("long"), F.col("src"), F.col("lap"))).otherwise(F.col("blocks"))
    there = F.when(whole, F.lit(block).cast("long")).otherwise(F.col("tail"))
    left = F.when(F.col("lap") == F.col("passes"), F.col("rest") - F.col("i") * block).otherwise(there)
    return each.select("shard", "src", "slot", index.alias("index"), F.least(there, left).alias("n_words"))


def laid_out(sized: DataFrame, sources: DataFrame, key: str, group: int) -> DataFrame:
    """Adds ``src`` and ``start``, the words of the source's documents before this one; null for those without words.

    Documents of a source are dealt to groups by a hash of key and text, so that no task numbers a whole source.
    """
    groups = -(-sized.count() // group) or 1
    rows = sized.join(small_or_joined(sources.select("source", "src").withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.col(key), F.col("digest")), F.lit(groups)))
    sums = rows.groupBy("src", "part").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("src").orderBy("part")) - F.col("words")
    inside = F.sum("size").over(Window.partitionBy("src", "part").orderBy(key, "size", "digest").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    out = rows.withColumn("inside", inside).join(sums.select("src", "part", before.alias("before")), ["src", "part"])
    return out.select(key, "source", "src", "size", F.when(F.col("size") > 0, F.col("before") + F.col("inside")).alias("start"))


def pieces(layout: DataFrame, block: int) -> DataFrame:
    """(src, start, index, low, high): the words of each block that a document holds, counted in the block; and ``first``, the place of the piece in the document."""
    end = F.col("start") + F.col("size")
    cut = layout.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("index"))
    at = F.col("index") * block
    return cut.select("src", "start", "index", (F.greatest("start", at) - at).alias("low"), (F.least(end, at + block) - at).alias("high"), (F.greatest("start", at) - F.col("start")).alias("first"))


def mixture(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2,
    block: int = BLOCK, shard: int = SHARD, seed: int = 42,
) -> Mixture:
    """The whole mix, as tables in the running operator's folder; see ``mix`` for what it does with odd rows."""
    found = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(key).alias(key), F.col(source).alias("source"), found.alias("size"), F.xxhash64(F.col(text).cast("string")).alias("digest"))
    sized = stored(sized, "sizes")
    sources = stored(quotas(targets(sized, weights, share, most), block), "sources")
    layout = stored(laid_out(sized, sources, key, GROUP), "layout")
    counts = shard_counts(docs.sparkSession, sources, shard, seed)
    return Mixture(sources, layout, stored(slots_of(counts, sources, block, seed), "slots"))


def mix(docs: DataFrame, key: str = "doc_id", block: int = BLOCK, **options) -> DataFrame:
    """(key, size, source_size, target, taken): every document with its source's target and the words that the mix takes of it.

    ``options`` as in ``mixture``: column names, weights, share of all words, cap, slots of a shard and seed. The words
    taken of a source are its target, rounded. No document gives a word more often than the cap, rounded up.

    Null and empty texts have size 0 and give nothing; a null source is a source, the last one. Null and repeated keys
    are documents of their own: rows count by their place, and rows alike in key, text and source may stand for each
    other. Long documents span many blocks. Empty tables give no rows. Only the named columns are read, whatever else
    there is. Runs over the same rows agree, however the rows are partitioned.
    """
    with run_folder(docs.sparkSession, "mixing"):
        found = mixture(docs, key, block=block, **options)
        parts = pieces(found.layout, block).join(found.slots.select("src", "index", "n_words"), ["src", "index"])
        overlap = F.greatest(F.least("high", "n_words") - F.col("low"), F.lit(0).cast("long"))
        taken = parts.groupBy("src", "start").agg(F.sum(overlap).alias("taken"))
        sources = found.sources.select("src", F.col("words").alias("source_size"), "target")
        rows = found.layout.join(taken, ["src", "start"], "left").join(small_or_joined(sources), "src")
        return kept(rows.select(key, "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")), "mixed")


def mixed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, seed: int = 42, **options) -> DataFrame:
    """(shard, place, source, text): the mix itself, a row a slot: the words of its block, with single spaces, in pseudorandom order within each shard.

    Options and odd rows as in ``mix``; keys must be unique here, as texts are found by them, and rows without a key are an error.
    """
    with run_folder(docs.sparkSession, "mixing"):
        found = mixture(docs, key, text, block=block, seed=seed, **options)
        cut = pieces(found.layout, block).join(found.layout.where("size > 0").select(key, "src", "start"), ["src", "start"])
        words = docs.select(F.col(key).alias(key), F.regexp_extract_all(F.col(text).cast("string"), F.lit(WORD), F.lit(0)).alias("words"))
        at = F.explode(F.arrays_zip("index", "low", "first", "high")).alias("p")
        lists = cut.groupBy(key, "src").agg(*[F.collect_list(c).alias(c) for c in ("index", "low", "first", "high")])  # a document's own
        parts = words.join(lists, key).select("src", "words", at).select("src", "p.index", "p.low", F.slice("words", F.col("p.first").cast("int") + 1, (F.col("p.high") - F.col("p.low")).cast("int")).alias("w"))
        both = found.slots.join(parts, ["src", "index"]).where("low < n_words")
        both = both.withColumn("w", F.slice("w", 1, F.least(F.size("w"), F.col("n_words") - F.col("low")).cast("int")))
        blocks = both.groupBy("shard", "src", "slot").agg(F.array_sort(F.collect_list(F.struct("low", "w"))).alias("w"))  # a block's own
        place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed).cast("long"), "src", "slot"), "src", "slot")) - 1
        named = blocks.withColumn("place", place).join(small_or_joined(found.sources.select("src", "source")), "src")
        return kept(named.select("shard", "place", "source", F.array_join(F.flatten(F.transform("w", lambda x: x["w"])), " ").alias("text")), "mixed-texts")
