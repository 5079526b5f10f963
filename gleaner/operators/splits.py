"""Leakage-safe split units and their deterministic splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sha1_bucket, split_of


def first_named(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def unit_name(members: Column) -> Column:
    """unit_ and 16 hex digits of the sorted member ids' digest."""
    return F.concat(F.lit("unit_"), F.substring(F.sha2(F.array_join(F.sort_array(members), "|"), 256), 1, 16))


def units(rows: DataFrame, group: str, key: str = "id") -> DataFrame:
    """(group, unit, size) of rows (key as string) that share a group."""
    return rows.groupBy(group).agg(F.collect_list(F.col(key).cast("string")).alias("m")).select(group, unit_name(F.col("m")).alias("unit"), F.size("m").cast("long").alias("size"))


def assign(rows: DataFrame, group: str, key: str = "id", forced: Column | None = None, seed: int = 1234) -> DataFrame:
    """(key, unit, split); a unit with a forced member goes to train as a whole."""
    named = units(rows, group, key)
    if forced is not None:
        named = named.join(rows.groupBy(group).agg(F.bool_or(forced).alias("forced")), group)
    split = split_of(F.col("unit"), seed)
    if forced is not None:
        split = F.when(F.col("forced"), "train").otherwise(split)
    return rows.select(key, group).join(named.withColumn("split", split), group).select(key, "unit", "split")


def dev_holdout(rows: DataFrame, key: str, family: str, share: float = 0.1) -> DataFrame:
    """rows with `dev`: per family, the round(share * n) members of smallest hash (1 to n - 1; none of a family of one)."""
    size = F.count("*").over(Window.partitionBy(family))
    rank = F.row_number().over(Window.partitionBy(family).orderBy(sha1_bucket(F.col(key).cast("string")), F.col(key)))
    take = F.least(size - 1, F.greatest(F.lit(1), F.bround(size * share, 0).cast("long")))
    return rows.withColumn("dev", (size > 1) & (rank <= take))
