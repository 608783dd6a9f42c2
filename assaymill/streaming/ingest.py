"""Incremental ingest: files that arrive in a folder become documents and blocks, each content once, whatever is restarted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from assaymill import schemas as S
from assaymill.plans.session import delete
from assaymill.sources import readers

#: Numbers that a batch has for its documents: ids are the batch's number times this and the place in the batch.
IDS_A_BATCH = 1 << 32


@dataclass
class Ingest:
    """A folder with tables that a stream of files fills: documents, blocks, refused. A batch is a folder ``batch=n`` in each.

    Batches are written whole, documents last: what a batch wrote before it died is written again by the same batch, and
    blocks without a batch of documents don't show. So every table holds each file's outcome exactly once.
    """

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def documents(self) -> DataFrame | None:
        """(document_id, path, file_name, suffix, length, file_hash, batch); None before the first batch."""
        return self._table("documents")

    def blocks(self) -> DataFrame | None:
        """Blocks of the documents, with their ``document_id``."""
        return self._shown("blocks")

    def refused(self) -> DataFrame | None:
        """(path, reason, batch) of files that weren't taken: unknown kinds, too large ones, content that was there before, no decoder."""
        return self._shown("refused")

    def _shown(self, name: str) -> DataFrame | None:
        done, rows = self.documents(), self._table(name)
        return None if done is None or rows is None else rows.join(F.broadcast(done.select("batch").distinct()), "batch", "left_semi")

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.drop("batch").write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def batch(self, files: DataFrame, number: int) -> None:
        """One batch of binary files (path, length, content). Running it again for the same number changes nothing."""
        known = self.documents()
        hashes = self.spark.createDataFrame([], "file_hash string") if known is None else known.where(F.col("batch") != number).select("file_hash").distinct()
        suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
        reason = F.when(~suffix.isin(S.UPLOAD_EXTENSIONS), "extension").when(F.col("length") > S.MAX_FILE_BYTES, "size")
        found = files.select("path", "length", "content", suffix.alias("suffix"), reason.alias("reason"))
        light = found.where("reason IS NULL").select("path", "length", "suffix", F.sha2("content", 256).alias("file_hash"))
        first = F.row_number().over(Window.partitionBy("file_hash").orderBy("path")) == 1
        fresh = light.join(hashes, "file_hash", "left_anti").withColumn("_first", first).where("_first").drop("_first")
        missing = readers.undecodable(fresh)
        fresh = fresh.join(missing.select("path"), "path", "left_anti")
        self._put(fresh, "pending", number)  # which files are new is decided once
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/pending/batch={number}")
        # numbers within a batch: the paths in order, by ranges, so that no task holds them all
        ranges = fresh.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path")
        named = ranges.select(F.monotonically_increasing_id().alias("n"), "path", F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "suffix", "length", "file_hash")
        small = (F.shiftright("n", 33) * (1 << 20) + F.col("n") % (1 << 33)).alias("n")  # at most 4096 ranges of a million files
        self._put(named.select((F.lit(number).cast("long") * IDS_A_BATCH + small).alias("document_id"), "path", "file_name", "suffix", "length", "file_hash"), "numbered", number)
        rows = self.spark.read.parquet(f"{self.path}/numbered/batch={number}")
        accepted = readers.accepted_files(files).join(rows.select("path", "document_id"), "path")
        blocks = readers.blocks_of(accepted.drop("document_id")).join(rows.select("path", "document_id"), "path")
        refused = found.where("reason IS NOT NULL").select("path", "reason").unionByName(missing)
        same = light.join(fresh.select("path"), "path", "left_anti").join(missing.select("path"), "path", "left_anti").select("path", F.lit("duplicate").alias("reason"))
        self._put(refused.unionByName(same), "refused", number)
        self._put(blocks, "blocks", number)
        self._put(rows, "documents", number)
        for name in ("pending", "numbered"):
            delete(self.spark, f"{self.path}/{name}/batch={number}")

    def start(self, source: str, files_a_batch: int = 1000, once: bool = True) -> StreamingQuery:
        """Follows a folder of files and its folders; ``once`` ends when all that is there is in. Progress is kept in the folder itself."""
        stream = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        stream = stream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(source)
        writer = stream.writeStream.foreachBatch(lambda rows, n: self.batch(rows, n)).option("checkpointLocation", f"{self.path}/progress")
        return (writer.trigger(availableNow=True) if once else writer).start()
