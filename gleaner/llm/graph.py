"""Connected components of a link table by alternating large-star and small-star rounds.

Rounds end when the edges are the same as before, told by their number and two sums of 64-bit hashes: two different
sets of edges agree in these with a chance of about 2^-64 a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, saved

MOST_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    """Count and two sums of hashes, added up per partition: equal for equal sets of edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)).cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (x, y) -> (node, label): the smallest node each node reaches; nodes without links are absent.

    Every round keeps one row per surviving edge and is written to the shared folder.  Minima per node are
    pre-aggregated on the map side and joined back, so a node with very many links never has to fit in one task.
    """
    edges = saved(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before = _mark(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "edges")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (
            large.join(small, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt = saved(nxt, "edges")
        discard(edges, large)
        edges, after = nxt, _mark(nxt)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
