"""Connected components by alternating minima over a node's larger and smaller neighbours."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one is made for one-process sessions only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="gleaner-cut-"))
        atexit.register(shutil.rmtree, _made[0], True)
    return f"file://{_made[0]}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(nodes: DataFrame, links: DataFrame, rounds: int = 50) -> DataFrame:
    """nodes (id), links (a, b) -> (id, root): root is the smallest id (by its type's order) that the id reaches."""
    def mark(table: DataFrame):
        """Count and two sums of hashes: equal for equal sets of edges."""
        h = F.xxhash64("hi", "lo")
        return table.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()

    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = mark(edges)
    for _ in range(rounds):
        around = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = around.groupBy("hi").agg(F.min("lo").alias("low")).select("hi", F.least("hi", "low").alias("low"))
        wide = around.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("low").alias("lo")).distinct()
        low = wide.groupBy("hi").agg(F.min("lo").alias("low"))
        joined = wide.join(low, "hi")
        narrow = joined.select("hi", F.col("low").alias("lo")).unionByName(joined.select(F.col("lo").alias("hi"), F.col("low").alias("lo")).where("hi <> lo")).distinct()
        edges = cut(narrow)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.select("id").join(edges.select(F.col("hi").alias("id"), F.col("lo").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
