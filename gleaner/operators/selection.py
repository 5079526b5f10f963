"""Quotas, diversity, plans and caps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut


def quota_select(rows: DataFrame, caps: DataFrame, target: int, buckets: list[str], key: str = "id", family: str = "family", bucket: str = "bucket", order: str = "ord") -> DataFrame:
    """Ordered pick: families up to floor(share * realised size), the whole up to the realised size.

    The realised size is min(target, rows); buckets come in the order given, unknown ones as the last; families
    without a row in caps (family, share) have no cap.  A family's skipped rows never free room for it, so ranks
    within families, then one rank over the survivors, give what a loop over rows gives.  Ranks over the survivors
    are only taken of rows that a bucket's running count leaves in question.
    """
    place = F.coalesce(F.array_position(F.lit(buckets), F.col(bucket)), F.lit(0))
    placed = rows.withColumn("_b", F.when(place == 0, len(buckets)).otherwise(place)).crossJoin(F.broadcast(rows.agg(F.least(F.lit(target), F.count("*")).alias("_size"))))
    placed = placed.join(F.broadcast(caps.select(F.col("family").alias(family), "share")), family, "left")
    in_family = F.row_number().over(Window.partitionBy(family).orderBy("_b", order, key))
    open_ = placed.withColumn("_f", in_family).where(F.col("share").isNull() | (F.col("_f") <= F.floor(F.col("share") * F.col("_size"))))
    # `target` rows at most leave this step, found by a distributed top-n
    best = open_.orderBy("_b", order, key).limit(target)
    rank = F.row_number().over(Window.orderBy("_b", order, key))
    return best.withColumn("rank", rank).where("rank <= _size").select(F.col(key), F.col(family), F.col(bucket), "rank")


def farthest_points(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, v) -> (rank, id): the longest vector, then k - 1 times the one farthest from all picked (ties: smallest id).

    Each round is one pass that keeps every row's distance to the nearest pick; picks (k vectors) go with the tasks.
    """
    start = rows.select("id", "v", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("far"))
    picked: list[tuple[int, list[float]]] = []
    for _ in range(k):
        if picked:
            points = np.array([v for _, v in picked])

            def nearest(parts: Iterator[pd.DataFrame], points=points) -> Iterator[pd.DataFrame]:
                for part in parts:
                    if len(part):
                        v = np.stack(part["v"].to_list())
                        far = ((v[:, None, :] - points[None, :, :]) ** 2).sum(axis=2).min(axis=1)
                        yield pd.DataFrame({"id": part["id"], "v": part["v"], "far": far})

            table = rows.select("id", "v").mapInPandas(nearest, "id long, v array<double>, far double")
        else:
            table = start
        best = table.orderBy(F.desc("far"), "id").limit(1).collect()
        if not best or (picked and best[0]["far"] <= 0):
            break
        picked.append((best[0]["id"], list(best[0]["v"])))
    return rows.sparkSession.createDataFrame([(i + 1, p) for i, (p, _) in enumerate(picked)], "rank int, id long")


def numbered(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """rows with `n`, a gapless number from 0 in that order, without a single task holding all rows.

    A range partitioning sorts; per-partition counts (one row a partition) give each partition its first number.
    """
    kept = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = kept.groupBy("_p").agg(F.count("*").alias("_c"))
    first = counts.withColumn("_first", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_first")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return kept.withColumn("_k", place).join(F.broadcast(first), "_p").withColumn("n", F.col("_first") + F.col("_k") - 1).drop("_p", "_k", "_first")
