"""Bootstrap with resamples of fixed size inside strata: every replicate draws as many units of a stratum as it has.

Units of one value are alike, so a stratum is its distinct values and how many units have each; a resample is a
multinomial draw of counts over them.  Values are dealt out to parts of bounded size.  First the stratum's draws are
split among the parts, by binomials each conditioned on the draws that are left; then every part deals its own among its
values.  Together that is the multinomial itself, and no task holds a stratum.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut

PART_VALUES = 20_000  #: distinct values of a part, about
BLOCK = 500  #: replicates that are drawn together
CELLS = 4 << 20  #: counts that a task holds at a time


def _random(seed: int, *parts) -> np.random.Generator:
    return np.random.default_rng([seed, *(zlib.crc32(str(p).encode()) for p in parts)])


def _split(n: int, sizes: np.ndarray, replicates: int, random: np.random.Generator) -> np.ndarray:
    """[replicate, part]: n draws over parts in proportion to their sizes, one binomial after the other."""
    left, whole, out = np.full(replicates, n), int(sizes.sum()), np.zeros((replicates, len(sizes)), np.int64)
    for k, size in enumerate(sizes.tolist()):
        out[:, k] = random.binomial(left, min(1.0, size / whole)) if whole > size else left
        left, whole = left - out[:, k], whole - size
    return out


def allotted(parts: DataFrame, replicates: int, seed: int) -> DataFrame:
    """parts (stratum, part, size) -> (stratum, part, block, draws): an array of the block's draws for each replicate."""
    blocks = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))))
    kind = parts.schema["stratum"].dataType.simpleString()

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        block = int(rows["block"].iloc[0])
        sizes = rows["size"].to_numpy()
        draws = _split(int(sizes.sum()), sizes, min(BLOCK, replicates - block * BLOCK), _random(seed, rows["stratum"].iloc[0], "parts", block))
        return pd.DataFrame({"stratum": rows["stratum"].to_numpy(), "part": rows["part"].to_numpy(), "block": block, "draws": list(draws.T)})

    return blocks.groupBy("stratum", "block").applyInPandas(deal, f"stratum {kind}, part int, block int, draws array<long>")


def replicate_sums(cells: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """cells (stratum, part, value, units) and their draws -> (stratum, part, replicate, drawn, total): counts and sums of values."""
    kind = cells.schema["stratum"].dataType.simpleString()

    def draw(key, values: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("value")
        value, units = values["value"].to_numpy(float), values["units"].to_numpy()
        share, out = units / units.sum(), []
        for block, n in zip(blocks["block"], blocks["draws"]):
            random, n = _random(seed, key[0], key[1], block), np.asarray(n)
            step = max(1, CELLS // len(value))
            for at in range(0, len(n), step):
                counts = random.multinomial(n[at : at + step], share)
                out.append(pd.DataFrame({"replicate": block * BLOCK + at + np.arange(len(counts)), "drawn": counts.sum(axis=1), "total": counts @ value}))
        return pd.concat(out).assign(stratum=key[0], part=key[1])[["stratum", "part", "replicate", "drawn", "total"]]

    by = ["stratum", "part"]
    return cells.groupBy(*by).cogroup(draws.groupBy(*by)).applyInPandas(draw, f"stratum {kind}, part int, replicate int, drawn long, total double")


def stratified_bootstrap(units: DataFrame, value: str, stratum: str | None, replicates: int = 10_000, seed: int = 0, confidence: float = 0.95, part_values: int = PART_VALUES) -> DataFrame:
    """(estimate, low, high, units, replicates): the mean of `value` and its percentile interval, resampling within strata.

    Null values take no part; a null stratum is one of its own; no units give a row of nulls.
    """
    rows = units.select((F.coalesce(F.col(stratum).cast("string"), F.lit("\x00")) if stratum else F.lit("")).alias("stratum"), F.col(value).cast("double").alias("value")).where("value IS NOT NULL")
    cells = cut(rows.groupBy("stratum", "value").agg(F.count("*").alias("units")))
    parts = max(1, -(-cells.count() // part_values))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("stratum", "value"), F.lit(parts)).cast("int"))
    draws = allotted(cells.groupBy("stratum", "part").agg(F.sum("units").alias("size")), replicates, seed)
    each = replicate_sums(cells, draws, seed).groupBy("replicate").agg((F.sum("total") / F.sum("drawn")).alias("mean"))
    tail = (1 - confidence) / 2
    spread = each.agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.count("*").alias("replicates"))
    point = cells.agg((F.sum(F.col("value") * F.col("units")) / F.nullif(F.sum("units"), F.lit(0))).alias("estimate"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"))
    return point.crossJoin(F.broadcast(spread)).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "units", "replicates")
