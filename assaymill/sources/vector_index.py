"""A stored vector index: immutable segments, tombstones and a log of commits in a folder; compaction in one step.

A batch of vectors becomes a segment of its own, a removal a list of ids or documents, and nothing is written twice. A
commit is one small file in the log, made only if no other writer took its number; what no commit names doesn't exist.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaymill.operators.neighbours import length_of, nearest
from assaymill.plans.session import delete

#: Commits after which a change compacts the index by itself.
COMPACT_AFTER = 64


class VectorIndex:
    """Rows (item_id, vector, ...) that can be added, replaced, removed and searched; all in ``path``, which drivers may share.

    Whole numbers are ids. A row that is added again replaces the older one. Rows without an id get negative numbers of
    their own. A batch has one length of vectors, the most frequent (the longer of two); rows of another length, without
    vector or with entries that aren't finite are skipped. Where its length isn't that of the index, the index begins
    anew with the batch: vectors of another length can't be compared with it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # the log

    def _log(self) -> list[dict[str, Any]]:
        """Commits in order from the last that stands for all before it."""
        try:
            lines = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.path}/log", wholetext=True).collect()
        except AnalysisException:  # nothing was ever committed
            return []
        commits = []
        for line in lines:
            try:
                commits.append(json.loads(line.value))
            except ValueError:  # its writer died; the number is taken
                continue
        commits.sort(key=lambda c: c["seq"])
        start = max((c["upto"] for c in commits if "upto" in c), default=-1)
        base = [c for c in commits if c.get("upto") == start][-1:]
        return base + [c for c in commits if c["seq"] > start and "upto" not in c]

    def _commit(self, **entry: Any) -> int:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        fs = folder.getFileSystem(conf)
        fs.mkdirs(folder)
        seq = max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")), default=-1) + 1
        while True:
            try:
                out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{seq:012d}.json"), False)
                break
            except Exception as taken:
                if "exist" not in str(taken).lower():
                    raise
                seq += 1
        out.write(bytearray(json.dumps(entry | {"seq": seq}).encode()))
        out.close()
        return seq

    def _written(self, rows: DataFrame, kind: str) -> tuple[str, DataFrame]:
        name = f"{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name, self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    # changes

    def add(self, items: DataFrame) -> int:
        """Adds or replaces; the number of rows that were taken."""
        dim = length_of(items)
        if not dim:
            return 0
        finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
        log = self._log()
        named = sum(c.get("rows", 0) for c in log) + max((c.get("before", 0) for c in log), default=0)
        number = F.coalesce(F.col("item_id").cast("long"), -(F.monotonically_increasing_id() + 1 + named))
        rows = items.where((F.size("vector") == dim) & finite).withColumn("item_id", number)
        name, written = self._written(rows, "segments")
        n, least = written.agg(F.count(F.lit(1)), F.min("item_id")).first()
        # numbers that this batch gave, so that no later one gives them again
        self._commit(kind="add", folder=name, dim=dim, rows=max(n, -(least or 0) - named), schema=written.schema.jsonValue())
        self._compacted_if_long()
        return n

    def remove(self, ids: DataFrame | None = None, documents: DataFrame | None = None) -> int:
        """Removes items by ``item_id`` or by ``document_id``, those that are there now; the number of rows that go."""
        column = "item_id" if documents is None else "document_id"
        dead = (ids if documents is None else documents).select(F.col(column).cast("long").alias(column)).where(F.col(column).isNotNull()).distinct()
        name, written = self._written(dead, "tombstones")
        there = self.live()
        gone = there.join(written, column, "left_semi").count() if column in there.columns else 0
        self._commit(kind="remove", folder=name, by=column)
        self._compacted_if_long()
        return gone

    def reset(self) -> None:
        """Nothing that was added before is there any more."""
        self._commit(kind="reset")

    def compact(self) -> None:
        """One segment in place of all commits so far; changes that others commit meanwhile stay after it."""
        log = self._log()
        if log:
            name, written = self._written(self._state(log), "segments")
            before = sum(c.get("rows", 0) for c in log) + max((c.get("before", 0) for c in log), default=0)
            self._commit(kind="compact", folder=name, dim=self._dim(log), upto=log[-1]["seq"] if "upto" not in log[-1] else log[-1]["upto"], before=before, schema=written.schema.jsonValue())

    def _compacted_if_long(self) -> None:
        if len(self._log()) > COMPACT_AFTER:
            self.compact()

    def vacuum(self) -> int:
        """Deletes folders that no commit in force names; only while nobody writes or reads. The number of folders."""
        jvm = self.spark.sparkContext._jvm
        used, gone = {c["folder"] for c in self._log() if "folder" in c}, 0
        for kind in ("segments", "tombstones"):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"{kind}/{s.getPath().getName()}" not in used:
                    delete(self.spark, s.getPath().toString())
                    gone += 1
        return gone

    # reading

    @staticmethod
    def _dim(log: list[dict[str, Any]]) -> int:
        return next((c["dim"] for c in reversed(log) if c.get("dim")), 0)

    @property
    def dimension(self) -> int:
        """The length of the vectors that are there; 0 for an index that never had any."""
        return self._dim(self._log())

    def _state(self, log: list[dict[str, Any]]) -> DataFrame:
        from pyspark.sql.types import StructType

        start, dim = 0, 0
        for i, c in enumerate(log):  # the last reset or change of length
            if c["kind"] == "reset" or c.get("dim", dim) != dim:
                start = i
            dim = c.get("dim", dim)
        rows = dead = None
        for c in log[start:]:
            if c["kind"] in ("add", "compact"):
                part = self.spark.read.schema(StructType.fromJson(c["schema"])).parquet(f"{self.path}/{c['folder']}").withColumn("_seq", F.lit(c["seq"] if c["kind"] == "add" else c["upto"]))
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
            elif c["kind"] == "remove":
                part = self.spark.read.schema(f"{c['by']} long").parquet(f"{self.path}/{c['folder']}").select(F.lit(c["by"]).alias("_by"), F.col(c["by"]).alias("_id"), F.lit(c["seq"]).alias("_at"))
                dead = part if dead is None else dead.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], "item_id long, vector array<float>")
        latest = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("_seq").desc(), F.xxhash64("vector"))) == 1
        rows = rows.withColumn("_last", latest).where("_last").drop("_last")
        for by in ("item_id", "document_id"):
            if dead is not None and by in rows.columns:
                last = dead.where(F.col("_by") == by).groupBy(F.col("_id").alias(by)).agg(F.max("_at").alias("_at"))
                rows = rows.join(last, by, "left").where("_at IS NULL OR _at < _seq").drop("_at")
        return rows.drop("_seq")

    def live(self) -> DataFrame:
        """The rows that are there now; later changes don't show in it."""
        return self._state(self._log())

    def search(self, queries: DataFrame, k: int = 5, same: Sequence[str] = (), other: Sequence[str] = (), **options: Any) -> DataFrame:
        """The k best items of each query (query_id, vector, ...), filtered as in ``neighbours.nearest``; queries of another length find nothing."""
        log = self._log()
        return nearest(queries, self._state(log), k, same, other, dim=self._dim(log) or None, **options)
