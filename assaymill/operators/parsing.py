"""From lines to blocks: offsets, headings above, merging of neighbouring lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assaymill import schemas as S
from assaymill.functions.text import line_kind
from assaymill.operators.cases import numbered


def lines(documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(document_id, line_no, block_type, level, text, start, end) of each line that isn't blank."""
    split = documents.select(F.col(key).alias("document_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    before = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    rows = split.withColumns({"start": start, "k": line_kind(F.col("line"))})
    return rows.where("k IS NOT NULL").select("document_id", "line_no", "k.block_type", "k.level", "k.text", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("line")).cast("long").alias("end"))


def merged(rows: DataFrame, limit: int = S.MAX_MERGE, keep_line: bool = False) -> DataFrame:
    """Neighbouring lines of one type that is no heading become one block: always up to ``limit`` characters, up to twice
    that only where the text so far doesn't end a sentence, beyond that never.

    Lines stream by in order, document by document, so a task holds a batch of them and the block that is being made.
    With ``keep_line`` a block keeps the number of its first line.
    """
    w = Window.partitionBy("document_id").orderBy("line_no")
    ends = F.coalesce(F.lag(F.col("text").rlike("[。！？；;….]$")).over(w), F.lit(False))
    flagged = rows.select("document_id", "line_no", "block_type", "level", "text", "start", "end", F.length("text").alias("n"), ends.alias("ended")).sortWithinPartitions("document_id", "line_no")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list | None = None
        document, position, size = None, 0, 0
        for b in batches:
            done = []
            for doc, line, kind, level, text, start, end, n, ended in zip(*(c.to_pylist() for c in b.columns), strict=True):
                same = block is not None and doc == document
                size += n
                if same and level is None and block[4] is None and kind == block[3] and (size <= limit or size <= 2 * limit and not ended):
                    block[5].append(text)
                    block[7], size = end, size + 1
                    continue
                if block is not None:
                    done.append(block)
                document, position, size = doc, position + 1 if same else 0, n
                block = [doc, line, position, kind, level, [text], start, end]
            yield made(done)
        yield made([block] if block is not None else [])

    def made(blocks: list[list]) -> pa.RecordBatch:
        columns = list(zip(*blocks, strict=True)) or [[]] * 8
        columns[5] = ["\n".join(t) for t in columns[5]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kind = rows.schema["document_id"].dataType
    schema = pa.schema([
        ("document_id", to_arrow_type(kind)), ("line_no", pa.int32()), ("position", pa.int32()), ("block_type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
    ])
    blocks = flagged.mapInArrow(fold, f"document_id {kind.simpleString()}, line_no int, position int, block_type string, level int, text string, start long, end long")
    return blocks if keep_line else blocks.drop("line_no")


def hierarchy(blocks: DataFrame, levels: int = 6) -> DataFrame:
    """Adds ``section_path`` (headings above, joined by `` / ``) and ``parent_position`` (the nearest of them).

    A heading of a level is above a block if no heading of that level or a higher one stands between them.
    """
    before = Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    out = blocks
    for k in range(1, levels + 1):
        # the last heading of level k, void once a higher one follows it
        out = out.withColumn(f"_p{k}", F.max(F.when(F.col("level") == k, F.col("position"))).over(before))
        out = out.withColumn(f"_t{k}", F.last(F.when(F.col("level") == k, F.col("text")), ignorenulls=True).over(before))
    above = []
    for k in range(1, levels + 1):
        higher = [F.coalesce(f"_p{j}", F.lit(-1)) for j in range(1, k)]
        last_higher = F.greatest(*higher) if len(higher) > 1 else (higher[0] if higher else F.lit(-1))
        valid = F.col(f"_p{k}").isNotNull() & (F.col(f"_p{k}") > last_higher) & (F.col("level").isNull() | (F.lit(k) < F.col("level")))
        above.append(F.when(valid, F.struct(F.col(f"_p{k}").alias("p"), F.col(f"_t{k}").alias("t"))))
    stack = F.array_compact(F.array(*above))
    path = F.when(F.size(stack) > 0, F.array_join(F.transform(stack, lambda x: x["t"]), " / ")).otherwise(S.UNFILED)
    parent = F.try_element_at(stack, F.lit(-1))["p"]
    drop = [f"_{x}{k}" for k in range(1, levels + 1) for x in "pt"]
    return out.withColumns({"section_path": path, "parent_position": parent}).drop(*drop)


def neighbours(blocks: DataFrame) -> DataFrame:
    """Adds the texts of the blocks before and after in the document, empty at its ends."""
    w = Window.partitionBy("document_id").orderBy("block_id")
    near = lambda f: F.coalesce(f("block_text").over(w), F.lit(""))
    return blocks.withColumns({"previous_text": near(F.lag), "next_text": near(F.lead)})


def context(blocks: DataFrame) -> DataFrame:
    """Adds ``context_ids``: the blocks one before and one after, in order of their ids."""
    w = Window.partitionBy("document_id").orderBy("block_id").rowsBetween(-1, 1)
    return blocks.withColumn("context_ids", F.array_sort(F.array_except(F.collect_list("block_id").over(w), F.array("block_id"))))


def with_ids(blocks: DataFrame) -> DataFrame:
    """Adds ``block_id``, a dense number in order of documents and positions, and ``parent_block_id`` for ``parent_position``."""
    known = numbered(blocks, "block_id", F.col("document_id"), F.col("position"))
    above = known.select("document_id", F.col("position").alias("parent_position"), F.col("block_id").alias("parent_block_id"))
    return known.join(above, ["document_id", "parent_position"], "left")
