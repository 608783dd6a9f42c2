"""What the training-data operators share: the shared folder, written tables that go when they are done with, row ids."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where the driver and the tasks are one machine and no folder is named.
LOCAL_DIR = "/tmp/checkpoints"
ROOT = str(Path(__file__).resolve().parents[2])
#: Of Python workers, unless set already: large arrays go back to the system once they are freed.
WORKER = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Bytes of an Arrow batch while an operator runs, where the session has Spark's default of 64 MB.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_run: ContextVar[str | None] = ContextVar("run", default=None)
_shipped: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed on them: on a cluster it is sent along."""
    context = spark.sparkContext
    for name, value in WORKER.items():
        context.environment.setdefault(name, value)
    if is_local(spark):
        if ROOT not in context.environment.get("PYTHONPATH", "").split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, context.environment.get("PYTHONPATH", "")]))
    elif context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        with tempfile.TemporaryDirectory() as folder:
            code = shutil.copytree(f"{ROOT}/assaymill", f"{folder}/code/assaymill", ignore=shutil.ignore_patterns("__pycache__"))
            archive = f"{tempfile.gettempdir()}/assaymill-{uuid.uuid4().hex}"  # Spark reads it whenever an executor starts
            context.addPyFile(shutil.make_archive(archive, "zip", Path(code).parent))


def trim() -> None:
    """Gives what a worker has freed back to the system: workers stay between stages, each beside the executor's heap."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES meanwhile, unless the session has its own size; afterwards as before."""
    before = spark.conf.get(BATCH)
    if before.rstrip("b") != str(64 << 20):
        yield
        return
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


@contextmanager
def run_folder(spark: SparkSession, name: str) -> Iterator[None]:
    """A folder for what an operator writes in between; it is deleted at the end, whatever happens."""
    ready(spark)
    path = fresh_path(spark, name)
    token = _run.set(path)
    try:
        with small_batches(spark):
            yield
    finally:
        _run.reset(token)
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder and all in it, in whatever file system it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent: a fixed folder in local mode, an error on a cluster.
    """
    ready(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_DIR


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the running operator's folder, or else the shared one, and read it back: lineage ends there."""
    return _written(df, f"{_run.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same for a result, which stays when the operator's folder goes."""
    return _written(df, fresh_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that is sent to all tasks at most.
ROWS_AT_ONCE = 500_000


def small_or_joined(table: DataFrame) -> DataFrame:
    """A written table to join with: broadcast where it is small, else left to a shuffled join, which splits hot keys."""
    return F.broadcast(table) if table.count() <= ROWS_AT_ONCE else table


def spread(spark: SparkSession) -> int:
    """The number of partitions for a shuffle whose count must be given."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, null text as empty; other columns can't clash."""
    return df.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
