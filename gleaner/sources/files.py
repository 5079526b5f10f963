"""Readers and writers at the engine's edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped and unknown keys dropped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_keeping(spark: SparkSession, path: str, schema: T.StructType, rest: str = "metadata") -> DataFrame:
    """As read_jsonl, with unknown keys gathered in a map of strings."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    known = F.from_json("value", schema).alias("o")
    every = F.from_json("value", "map<string,string>")
    return lines.select(known, F.map_filter(every, lambda k, v: ~k.isin(*schema.names)).alias(rest)).select("o.*", rest)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_jsonl(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap by two renames; the old folder is kept as .bak.

    Readers never see a part of either, but between the renames there is no table; a crash there leaves the old one as .bak.
    """
    spark = df.sparkSession
    fresh = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.json(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, new, old = hadoop.Path(path), hadoop.Path(fresh), hadoop.Path(f"{path}.bak")
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
    fs.rename(new, target)


def write_report_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A fixed column contract: nulls are empty cells and nested values JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = [F.to_json(c).alias(c) if isinstance(kinds.get(c), nested) else F.col(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*cells).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_cubes(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of .cube files under a folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.cube").text(path)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("content"))


def walk(spark: SparkSession, path: str, include: str = "*", exclude: str | None = None) -> DataFrame:
    """(path, length, sha256) of files under a folder, in path order on disk."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", include).load(path)
    files = files.where(~F.regexp_like("path", F.lit(exclude))) if exclude else files
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height) of PNG files, from the header alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return files.where(F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A").select("path", number(17).alias("width"), number(21).alias("height"))
