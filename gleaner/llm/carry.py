"""Columns by exact name and place, so that other columns may be called anything (even the same in another case)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import bounded_batches


def _plain(df: DataFrame) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns: output name = name in df."""
    return _plain(df).select(*[F.col(f"c{df.columns.index(name)}").alias(out) for out, name in wanted.items()])


def carried(df: DataFrame, apart: str | None = None, **wanted: str) -> DataFrame:
    """The wanted columns and `_row`, a struct of all columns of df (without `apart`) by place."""
    fields = [F.col(f"c{i}") for i, name in enumerate(df.columns) if name != apart] or [F.lit(None).cast("int").alias("none")]
    return _plain(df).select(F.struct(*fields).alias("_row"), *[F.col(f"c{df.columns.index(name)}").alias(out) for out, name in wanted.items()])


def restored(df: DataFrame, new: dict[str, Column] = {}) -> list[Column]:
    """The columns of df out of `_row`, in order; `new` replaces or follows them."""
    own = [new[name].alias(name) if name in new else F.col(f"_row.c{i}").alias(name) for i, name in enumerate(df.columns)]
    return own + [c.alias(name) for name, c in new.items() if name not in df.columns]
