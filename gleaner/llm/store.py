"""Intermediate tables in the folder that all executors share.

A saved table cuts the lineage: later stages read files that survive a lost executor.  The folder is the session's
`spark.checkpoint.dir`; only where that is unset and Spark runs in this one process, a temporary folder is used.

An operator's tables must last until its result is consumed, which only the caller knows: `made` lists them, and
`sweep` deletes those of a finished step.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
made: list[str] = []  #: paths of the tables that this process has saved and not deleted, in order


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/gleaner"
    master = spark.conf.get("spark.master", "local[*]")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="gleaner-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and return the written table."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleaner_path = path
    made.append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that no later stage reads."""
    for df in tables:
        path = getattr(df, "_gleaner_path", None)
        if path:
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables saved after the first `since` of `made`, but `keep`."""
    for path in list(made[since:]):
        if path != getattr(keep, "_gleaner_path", None):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if path in made:
        made.remove(path)
