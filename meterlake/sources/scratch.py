"""Paths in the folder that driver and executors share, removed when the application ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and Spark runs inside one process (tests), a temporary folder is set; on a cluster that
    would lose data with the machine, so there it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="meterlake-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}-{label}"
    atexit.register(discard, spark, path)
    return path


def stored(table: DataFrame, label: str) -> DataFrame:
    """``table`` written to a scratch path and read back, for rows that cost much and are read more than once."""
    path = scratch_path(table.sparkSession, label)
    table.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch path through Hadoop's file system; an ended session is no error."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        return


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Hadoop knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
