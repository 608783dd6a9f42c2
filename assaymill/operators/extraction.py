"""Testable statements from blocks by rules, their dedup inside and across blocks, and exclusion records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.functions.scoring import confidence
from assaymill.functions.text import classified, cleaned_statement, constraints, dedup_key, json_list, sentences, skippable, trimmed, truncated
from assaymill.plans.session import checkpoints


def source_text(blocks: DataFrame) -> DataFrame:
    """A table row's question, where it has one, stands for its text."""
    asked = (F.col("block_type") == "excel_row") & (F.coalesce("question", F.lit("")) != "")
    return blocks.withColumn("source_text", F.when(asked, F.col("question")).otherwise(F.col("block_text")))


def statements(blocks: DataFrame, text: str = "block_text") -> DataFrame:
    """One row per statement of each block that is no title: the first of each cleaned sentence, classified."""
    rows = blocks.where("block_type <> 'title'").where(~skippable(F.col(text))).select("block_id", F.posexplode(sentences(F.col(text))).alias("position", "sentence"))
    rows = rows.where(~skippable(F.col("sentence"))).withColumns({"c": classified(F.col("sentence")), "whole": cleaned_statement(F.col("sentence"))})
    first = F.row_number().over(Window.partitionBy("block_id", "whole").orderBy("position")) == 1
    rows = rows.where("c IS NOT NULL AND whole <> ''").withColumn("_first", first).where("_first")
    return rows.select(
        "block_id", "position", truncated(F.col("whole")).alias("statement"), "c.eiu_type", "c.content_priority", constraints(F.col("sentence")).alias("constraints"),
        F.array("block_id").alias("evidence_blocks"), F.lit(True).alias("is_questionable"), F.lit(None).cast("string").alias("exclusion_reason"),
        F.lit("offline-rule-based").alias("extraction_model"), F.lit(0.5).alias("extraction_confidence"),
    )


def exclusions(blocks: DataFrame, found: DataFrame, reason: str = "无实质内容") -> DataFrame:
    """A record of each block that is no title and gave no statement."""
    rest = blocks.where("block_type <> 'title'").join(found.select("block_id").distinct(), "block_id", "left_anti")
    none = F.lit(None).cast("string")
    empty = F.struct(*[none.alias(c) for c in ("subject", "condition", "scope", "period", "currency", "unit")])
    return rest.select(
        "block_id", F.lit(0).alias("position"), F.lit(f"[排除] {reason}").alias("statement"), F.lit("rule").alias("eiu_type"), F.lit("P2").alias("content_priority"),
        empty.alias("constraints"), F.array("block_id").alias("evidence_blocks"), F.lit(False).alias("is_questionable"), F.lit(reason[:128]).alias("exclusion_reason"),
        F.lit("skip-filter").alias("extraction_model"), F.lit(0.0).alias("extraction_confidence"),
    )


def across_blocks(items: DataFrame) -> DataFrame:
    """Questionable statements whose key an earlier block has are kept as excluded; those of one block aren't compared.

    Statements that aren't asked about have no key and take no part; a key's first block is a minimum over a window,
    which is made of the rows with a key alone.
    """
    rows = items.withColumn("_key", F.when(F.col("is_questionable"), dedup_key(F.col("statement"))))
    keyed, rest = rows.where("_key IS NOT NULL"), rows.where("_key IS NULL").drop("_key")
    first = keyed.groupBy("_key").agg(F.min("block_id").alias("_first"))
    out = keyed.join(first, "_key")
    again = F.col("_first") < F.col("block_id")
    marked = out.withColumns({
        "is_questionable": ~again, "exclusion_reason": F.when(again, "与已抽取知识点语义重复（同义去重）").otherwise(F.col("exclusion_reason")),
    }).drop("_key", "_first")
    return marked.select(items.columns).unionByName(rest.select(items.columns))


def extracted(blocks: DataFrame) -> DataFrame:
    """The whole rule-based run: statements, exclusion records, duplicates across blocks marked. Blocks and statements are
    made once and written, for several steps read them."""
    checkpoints(blocks.sparkSession)
    blocks = blocks.checkpoint()
    found = statements(blocks).checkpoint()
    return across_blocks(found).unionByName(exclusions(blocks, found))


def normalised(items: DataFrame, model: str) -> DataFrame:
    """Statements that a model replied, (block_id, item), in the shape of the rules' own; those without text or of an unknown type are dropped.

    Unknown priorities are P2, statements that aren't asked about have a reason, and others none.
    """
    text = trimmed(F.coalesce("item.statement", F.lit("")))
    kind, priority = trimmed(F.coalesce("item.eiu_type", F.lit(""))), trimmed(F.coalesce("item.content_priority", F.lit("P2")))
    asked = F.coalesce("item.is_questionable", F.lit(True))
    reason = F.coalesce(F.nullif(trimmed(F.coalesce("item.exclusion_reason", F.lit(""))), F.lit("")), F.lit(S.NO_REASON))
    return items.where((text != "") & kind.isin(S.STATEMENT_TYPES)).select(
        "block_id", truncated(text).alias("statement"), kind.alias("eiu_type"), F.when(priority.isin(list(S.PRIORITY_WEIGHT)), priority).otherwise("P2").alias("content_priority"),
        F.struct(*[F.col("item.constraints")[c].alias(c) for c in S.CONSTRAINT_KEYS]).alias("constraints"), F.array("block_id").alias("evidence_blocks"), asked.alias("is_questionable"),
        F.when(~asked, reason).alias("exclusion_reason"), F.lit(model).alias("extraction_model"), confidence(F.col("item.extraction_confidence")).alias("extraction_confidence"),
        F.lit("candidate").alias("review_status"),
    )


#: A statement in a model's reply.
ITEM = "struct<statement:string,eiu_type:string,content_priority:string,is_questionable:boolean,exclusion_reason:string,constraints:map<string,string>,extraction_confidence:double>"


def from_replies(replies: DataFrame, model: str) -> DataFrame:
    """Statements of the replies (block_id, reply)."""
    return normalised(replies.select("block_id", F.explode(json_list(F.col("reply"), ITEM)).alias("item")), model)


#: Vectors of a block that are compared with those of another at once, and their bytes.
BLOCK, BLOCK_BYTES = 4096, 8 << 20


def near_pairs(items: DataFrame, threshold: float, group: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of items of one group whose inner product is the threshold or more.

    A group's vectors go in blocks of bounded rows and bytes. Which blocks meet is settled by their numbers, and each
    vector goes to its block's meetings by the numbers of both blocks, so no key stands for a group; only near pairs
    become rows.
    """
    sizes = items.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(8 * F.greatest(F.size("vector"), F.lit(0))) / BLOCK_BYTES)).alias("parts"))
    parts = sizes.where(F.col("parts").isNotNull()).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    vector = F.transform("vector", lambda x: x.cast("double"))
    rows = items.select(F.col(group).alias("g"), F.struct(F.col("item_id").cast("long").alias("id"), vector.alias("v")).alias("row"))
    dealt = rows.join(sizes, "g").select("g", F.pmod(F.xxhash64("row.id"), "parts").alias("p"), "row")
    blocks = dealt.groupBy("g", "p").agg(F.collect_list("row").alias("rows"))
    meet = parts.select("g", F.col("p").alias("p_a"), F.explode(F.sequence("p", F.col("parts") - 1)).alias("p_b"))
    one, other = (blocks.select("g", F.col("p").alias(f"p_{s}"), F.col("rows").alias(s)) for s in "ab")
    pairs = meet.join(one, ["g", "p_a"]).join(other, ["g", "p_b"]).select("a", "b").repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (x, v), (y, w) = ((r.field("id").to_numpy(), r.field("v")) for r in (batch.column(c)[i].values for c in (0, 1)))
                for n in np.unique(v.value_lengths().fill_null(0)):  # only vectors of one length have a product
                    k, m = (np.flatnonzero(u.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == n) for u in (v, w))
                    a, b = (u.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n) if n else np.zeros((len(at), 0)) for u, at in ((v, k), (w, m)))
                    r, c = np.nonzero(a @ b.T >= threshold)
                    p, q = x[k[r]], y[m[c]]
                    pair = np.unique(np.column_stack([np.minimum(p, q), np.maximum(p, q)])[p != q], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["id_a", "id_b"])

    return pairs.mapInArrow(go, "id_a long, id_b long")


def greedy_dedup(items: DataFrame, threshold: float = S.DEDUP_COSINE, group: str = "grp") -> DataFrame:
    """(item_id, kept): in order of ids, an item is kept unless an earlier kept one of its group is as near as the threshold.

    Near pairs come from blocks of a group; then each round decides the items whose earlier neighbours are decided,
    until none is left. Written rounds cut the lineage.
    """
    checkpoints(items.sparkSession)
    near = near_pairs(items, threshold, group).checkpoint()
    state = items.select("item_id").join(near.select(F.col("id_b").alias("item_id")).distinct().withColumn("kept", F.lit(None).cast("boolean")).withColumn("_in", F.lit(True)), "item_id", "left")
    state = state.select("item_id", F.when(F.col("_in").isNull(), True).alias("kept")).checkpoint()
    while not state.where("kept IS NULL").isEmpty():
        earlier = near.join(state.withColumnRenamed("item_id", "id_a").withColumnRenamed("kept", "k_a"), "id_a")
        seen = earlier.groupBy(F.col("id_b").alias("item_id")).agg(F.bool_or(F.coalesce("k_a", F.lit(False))).alias("hit"), F.bool_and(F.col("k_a").isNotNull()).alias("known"))
        state = state.join(seen, "item_id", "left").select("item_id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.col("known"), True).alias("kept")).checkpoint()
    return state
