"""Intermediate tables in the folder that driver and executors share.

Lineage is cut with written tables rather than ``localCheckpoint``: a lost executor
then costs a re-read, not the data.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_made: list[str] = []
#: What the innermost ``settle`` of this thread has staged so far.
_within: ContextVar[list[str] | None] = ContextVar("within", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none, one of our own on a single machine; a cluster has to name it."""
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(CHECKPOINT_DIR, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    if (within := _within.get()) is not None:
        within.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of what was written."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _file_system(spark, path)
    return system.exists(found)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    system, found = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(found)] if system.exists(found) else []


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        system, found = _file_system(spark, path)
        system.delete(found, True)


def settle(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes, staged; the tables that it staged on the way are deleted."""
    made: list[str] = []
    outer = _within.set(made)
    try:
        result = stage(build(), label)
    finally:
        _within.reset(outer)
    *passed, last = made
    if (within := _within.get()) is not None:
        within.append(last)
    for path in passed:
        _made.remove(path)
    delete(spark, passed)
    return result


def clear(spark: SparkSession) -> None:
    """Delete what this session has staged; call it when results that read it are written."""
    delete(spark, _made)
    _made.clear()
