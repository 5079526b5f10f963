"""Validation as data: each row gets the list of what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns a registry row needs, and the tiers there are.
REQUIRED = ("source_family", "source_pack_id", "file_hash", "canonical_domain_id")
TIERS = ("gold", "diagnostic_only", "rejected")
ACCESS = ("download", "api", "local", "generated")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def registry_errors(required=REQUIRED, tier: str = "representability_tier") -> Column:
    checks = [F.when(blank(F.col(c)), F.lit(f"missing_{c}")) for c in required]
    return F.array_compact(F.array(*checks, F.when(~blank(F.col(tier)) & ~F.col(tier).isin(*TIERS), F.lit("bad_tier"))))


def require_valid(df: DataFrame, errors: str, rejected: Column) -> DataFrame:
    """df unchanged; the job fails on the first row that has errors and isn't rejected."""
    bad = (F.size(errors) > 0) & ~rejected
    return df.withColumn(errors, F.when(bad, F.raise_error(F.concat(F.lit("invalid row: "), F.array_join(errors, ", "))).cast("array<string>")).otherwise(F.col(errors)))


def removal_scope(rows: DataFrame, family: str, uses: list[str], digest: str) -> DataFrame:
    """One row: which uses a family had (each asks for an action) and its distinct hashes, sorted."""
    own = rows.where(F.col("family") == family)
    return own.agg(*[F.coalesce(F.bool_or(u), F.lit(False)).alias(u) for u in uses], F.sort_array(F.collect_set(digest)).alias("hashes"), F.count("*").alias("n"))
