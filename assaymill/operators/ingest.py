"""Uploads: validation, precheck against known documents, replacement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaymill import schemas as S
from assaymill.operators.cases import numbered, without_document
from assaymill.sources import readers


def rejected(files: DataFrame) -> DataFrame:
    """(path, reason) of files with an unknown extension or above the size limit."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    reason = F.when(~suffix.isin(S.UPLOAD_EXTENSIONS), "extension").when(F.col("length") > S.MAX_FILE_BYTES, "size")
    return files.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def prechecked(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``status``: duplicate (same content), conflict (same name and folder), elsewhere (same name in another folder) or ok."""
    folder = F.coalesce("folder_path", F.lit(""))
    known = documents.select("file_name", folder.alias("folder_path"), "file_hash")
    hashes = known.select("file_hash", F.lit(True).alias("_same")).distinct()
    places = known.select("file_name", "folder_path", F.lit(True).alias("_place")).distinct()
    names = known.select("file_name", F.lit(True).alias("_name")).distinct()
    rows = uploads.withColumn("folder_path", folder).join(hashes, "file_hash", "left").join(places, ["file_name", "folder_path"], "left").join(names, "file_name", "left")
    status = F.when(F.col("_same"), "duplicate").when(F.col("_place"), "conflict").when(F.col("_name"), "elsewhere")
    return rows.withColumn("status", status.otherwise("ok")).select(*uploads.columns, "status")


def triaged(checked: DataFrame) -> DataFrame:
    """Adds ``action``: skip duplicates, confirm conflicts and names known elsewhere, upload the rest directly."""
    return checked.withColumn("action", F.when(F.col("status") == "duplicate", "skip").when(F.col("status").isin("conflict", "elsewhere"), "confirm").otherwise("direct"))


def accepted(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Uploads of new content, one of each."""
    return uploads.join(documents.select("file_hash"), "file_hash", "left_anti").dropDuplicates(["file_hash"])


def replaced(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks with those of the documents in ``new`` exchanged for its rows."""
    return blocks.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


@dataclass
class Ingested:
    """What an upload writes: rows of its new documents and their blocks; ``refused`` says why other files aren't taken."""

    documents: DataFrame
    blocks: DataFrame
    refused: DataFrame


def ingested(spark: SparkSession, path: str, documents: DataFrame, first_id: int, skip_undecodable: bool = False) -> Ingested:
    """The files under a path that are new by their content, parsed; of equal ones the first by name is taken."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = readers.files(spark, path).withColumn("file_hash", F.sha2("content", 256))
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("path")) == 1
    fresh = found.join(documents.select("file_hash"), "file_hash", "left_anti").withColumn("_first", first).where("_first").drop("_first")
    refused = rejected(raw.select("path", "length")).unionByName(
        found.select("path").join(fresh.select("path"), "path", "left_anti").select("path", F.lit("duplicate").alias("reason"))
    )
    if skip_undecodable:
        missing = readers.undecodable(fresh)
        refused, fresh = refused.unionByName(missing), fresh.join(missing.select("path"), "path", "left_anti")
    named = fresh.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "suffix", "length", "file_hash")
    rows = numbered(named, "document_id", F.col("path")).withColumn("document_id", F.col("document_id") + first_id - 1)
    blocks = readers.blocks_of(fresh).join(rows.select("path", "document_id"), "path")
    return Ingested(rows.withColumn("parse_status", F.lit("completed")), blocks, refused)


def reuploaded(document_id: int, new: Ingested, documents: DataFrame, blocks: DataFrame, eiu: DataFrame, cases: DataFrame, checks: DataFrame) -> list[DataFrame]:
    """The five tables after a document was exchanged: the new rows in, the old document and all that hangs on it out.

    Frozen versions aren't touched. Where nothing new was taken, all stays as it is.
    """
    taken = F.broadcast(new.documents.agg((F.count(F.lit(1)) > 0).alias("_taken")))  # one row
    left = without_document(document_id, documents, blocks, eiu, cases, checks)
    tables = [documents, blocks, eiu, cases, checks]
    out = [a.join(taken).where("_taken").drop("_taken").unionByName(b.join(taken).where("NOT _taken").drop("_taken")) for a, b in zip(left, tables, strict=True)]
    add = lambda old, rows: old.unionByName(rows.select([c for c in old.columns if c in rows.columns]), allowMissingColumns=True)
    return [add(out[0], new.documents), add(out[1], new.blocks), *out[2:]]
