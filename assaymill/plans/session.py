"""Settings that a query needs from the session."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only in local mode, where the driver and the tasks are one machine and no folder is named.
LOCAL_DIR = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where none is named, a fixed one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    """A folder and all in it, in whatever file system it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def temporary(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets, for tables that a query builds and reads; the file system deletes it when the driver ends."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{folder.toString()}/tables"
