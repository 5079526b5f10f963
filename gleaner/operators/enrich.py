"""Incremental enrichment: only what has not been measured at this version is measured.

A row is known by its key and by the digest of what is measured.  A run reuses the results of the table's current
version whose digest and measuring version agree, measures the others, and commits both as a new version; results of rows that
are gone go with them.  Where a row has nothing to be measured (a null digest) nothing is committed at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import commit, current
from .components import cut


class Unresolved(ValueError):
    """Some rows have nothing to be measured; the table is as it was."""


@dataclass
class Report:
    reused: int
    measured: int
    removed: int
    committed: bool


def enrich(rows: DataFrame, target: str, version: str, measure: Callable[[DataFrame], DataFrame], key: str = "id", digest: str = "digest", unneeded: str | None = None) -> tuple[DataFrame, Report]:
    """rows (key, digest, what `measure` needs) -> the table (key, digest, version, and the columns that `measure` gives by key), and what was done.

    measure: rows -> a DataFrame with one row for each key.  unneeded: a condition of rows that need no result.  A second run with the same
    rows and version measures and commits nothing.  Keys must be distinct.
    """
    spark = rows.sparkSession
    wanted = rows.where(f"NOT coalesce({unneeded}, false)") if unneeded else rows
    lost = wanted.where(F.col(digest).isNull() | F.col(key).isNull()).count()
    if lost:
        raise Unresolved(f"{lost} rows have nothing to be measured")
    held = current(spark, target)
    if held is None:
        todo, reused = wanted, None
    else:
        same = held.where(F.col("version") == version)
        todo = wanted.join(same.select(key, digest), [key, digest], "left_anti")
        reused = same.join(wanted.select(key, digest), [key, digest], "left_semi")
    todo = cut(todo)
    found = cut(measure(todo).join(todo.select(key, digest), key).withColumn("version", F.lit(version)))
    n, kept = found.count(), 0 if reused is None else reused.count()
    if n != todo.count():
        raise ValueError(f"{todo.count()} rows were to be measured, {n} results came")
    removed = 0 if held is None else held.count() - kept
    if held is not None and n == 0 and removed == 0:
        return held, Report(kept, 0, 0, False)
    columns = [key, digest, "version", *[c for c in found.columns if c not in (key, digest, "version")]]
    out = found.select(*columns)
    if reused is not None and kept:
        if set(reused.columns) != set(columns):
            raise ValueError("the measuring gives other columns than the table has; change the version")
        out = out.unionByName(reused.select(*columns))
    return commit(out, target), Report(kept, n, removed, True)
