"""Versioned tables: every state of a table is a folder of its own, and a pointer file names the one that holds.

A new version is written whole before the pointer is replaced by one rename, so readers have the old rows or the new
ones, and a run that dies before leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    return fs, at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def current_version(spark: SparkSession, target: str) -> str | None:
    """The folder that holds now, or None before the first commit."""
    _, at, system = _hadoop(spark, f"{target}/{POINTER}")
    if not system.exists(at):
        return None
    return f"{target}/{spark.read.text(f'{target}/{POINTER}').first()[0].strip()}"


def current(spark: SparkSession, target: str) -> DataFrame | None:
    path = current_version(spark, target)
    return spark.read.parquet(path) if path else None


def commit(df: DataFrame, target: str) -> DataFrame:
    """Make df the table's rows, and read them back; older versions stay until `vacuum`."""
    spark = df.sparkSession
    before = current_version(spark, target)
    number = int(before.rsplit("/v", 1)[1].split("-")[0]) + 1 if before else 1
    name = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{target}/{name}")
    fs, draft, system = _hadoop(spark, f"{target}/.{name}")
    out = system.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = fs.FileContext.getFileContext(system.getUri(), system.getConf())
    context.rename(draft, fs.Path(f"{target}/{POINTER}"), options)
    return spark.read.parquet(f"{target}/{name}")


def vacuum(spark: SparkSession, target: str, keep: int = 1) -> int:
    """Delete versions but the current one and the `keep` before it; unfinished ones go, too.  How many went."""
    held = current_version(spark, target)
    fs, at, system = _hadoop(spark, target)
    names = sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("v"))
    own = held.rsplit("/", 1)[1] if held else ""
    older = [n for n in names if n < own]
    gone = [n for n in names if n != own and n not in older[len(older) - keep :]] if keep else [n for n in names if n != own]
    for name in gone:
        system.delete(fs.Path(f"{target}/{name}"), True)
    return len(gone)
