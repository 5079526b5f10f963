"""Deterministic buckets from cryptographic hashes, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 10_000_000
RATIOS = (("train", 0.80), ("eval", 0.90), ("diagnostic", 0.97), ("qualitative", 1.0))


def sha256_mod(value: Column, modulus: int = MODULUS) -> Column:
    """The 256-bit digest modulo `modulus`: eight 32-bit parts, each weighted by its power of 2^32, fit in a long."""
    digest = F.sha2(value, 256)
    parts = [
        (F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") % modulus * F.lit(pow(1 << 32, 7 - k, modulus))) % modulus
        for k in range(8)
    ]
    return reduce(lambda a, b: a + b, parts) % modulus


def split_of(unit: Column, seed: int = 1234, edges=RATIOS) -> Column:
    """The split whose cumulative ratio is the first above the unit's hash fraction."""
    fraction = sha256_mod(F.concat(unit, F.lit(f":{seed}"))) / MODULUS
    out = F.when(fraction < edges[0][1], edges[0][0])
    for name, edge in edges[1:-1]:
        out = out.when(fraction < edge, name)
    return out.otherwise(edges[-1][0])


def sha1_bucket(key: Column, buckets: int = 10_000) -> Column:
    """First 32 bits of the digest, modulo `buckets`."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % buckets


def held_out(key: Column, share: float, buckets: int = 10_000) -> Column:
    """Whether a key falls in the holdout; an empty key never does."""
    if share <= 0:
        return F.lit(False)
    named = F.coalesce(key, F.lit("")) != ""
    return named if share >= 1 else named & (sha1_bucket(F.coalesce(key, F.lit(""))) < round(share * buckets))


def sql_sha256_mod(value: str, modulus: int = MODULUS) -> str:
    parts = " + ".join(f"((('0x' || substr(sha256({value}), {8 * k + 1}, 8))::BIGINT % {modulus}) * {pow(1 << 32, 7 - k, modulus)}) % {modulus}" for k in range(8))
    return f"(({parts}) % {modulus})"


def sql_split(unit: str, seed: int = 1234, edges=RATIOS) -> str:
    x = f"({sql_sha256_mod(f"{unit} || ':{seed}'")} / {MODULUS}.0)"
    whens = " ".join(f"WHEN {x} < {edge} THEN '{name}'" for name, edge in edges[:-1])
    return f"CASE {whens} ELSE '{edges[-1][0]}' END"


def sql_sha1_bucket(key: str, buckets: int = 10_000) -> str:
    return f"(('0x' || substr(sha1({key}), 1, 8))::BIGINT % {buckets})"
