"""Interval estimates, paired tests and bootstraps as Column expressions and grouped frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054  # the normal quantile at 0.975


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, cut to [0, 1]; null for n = 0."""
    p, k, n = k / n, k.cast("double"), n.cast("double")
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def gate(lower: Column, upper: Column, n: Column, least_n: Column, threshold: Column, direction: Column) -> Column:
    """pass or fail of a bound against its threshold; too few units give no verdict."""
    met = F.when(direction == "min", lower >= threshold).otherwise(upper <= threshold)
    return F.when(n < least_n, "not-evaluable-below-min_N").when(met, "pass").otherwise("fail")


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """(p, statistic) of the exact two-sided test on b and c discordant pairs; (1, 0) without any."""
    n, low = b + c, F.least(b, c)
    # One fold carries ln of the binomial coefficient along with the sum.
    def add(s, i):
        ways = s["ways"] + F.when(i == 0, 0.0).otherwise(F.ln((n - i + 1).cast("double")) - F.ln(F.greatest(i, F.lit(1)).cast("double")))
        return F.struct(ways.alias("ways"), (s["tail"] + F.exp(ways - n * math.log(2))).alias("tail"))

    tail = F.aggregate(F.sequence(F.lit(0), low.cast("int")), F.struct(F.lit(0.0).alias("ways"), F.lit(0.0).alias("tail")), add, lambda s: s["tail"])
    stat = F.when(n == 0, 0.0).otherwise(F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double"), 2) / n)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), stat


def holm(tests: DataFrame, p: str = "p", name: str = "name", alpha: float = 0.05) -> DataFrame:
    """tests with threshold and rejected: p-values in order, each against alpha over those left, up to the first miss.

    A family of tests is a handful of rows, ranked together.
    """
    order = Window.orderBy(p, name)
    ranked = tests.withColumn("rank", F.row_number().over(order)).crossJoin(F.broadcast(tests.agg(F.count("*").alias("m"))))
    limit = F.lit(alpha) / (F.col("m") - F.col("rank") + 1)
    tested = ranked.withColumn("threshold", limit)
    kept = F.min((F.col(p) <= F.col("threshold")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return tested.withColumn("rejected", kept == 1).drop("m")


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the digest of the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)


def poisson_weight(digest: Column) -> Column:
    """A Poisson(1) count from a hex digest, a bootstrap count that needs no other row: the quantile of its first eight digits as a number in [0, 1).

    Digits of one length are in the order of their numbers, so the digest is compared with the bounds as text.
    """
    out, cumulative, term = None, 0.0, math.exp(-1)
    for k in range(8):
        cumulative += term
        below = digest < f"{math.ceil(cumulative * (1 << 32)):08x}"
        out = F.when(below, k) if out is None else out.when(below, k)
        term /= k + 1
    return out.otherwise(8)


def bootstrap_ratio(units: DataFrame, num: str, den: str, key: str, replicates: int, seed: int, by: list[str] = []) -> DataFrame:
    """Per group: the ratio of sums and its 2.5 and 97.5 percentiles over replicates.

    Units enter each replicate with a Poisson(1) count, so replicates are sums that every partition adds up on its
    own; the shuffle carries one row per group and replicate from each.
    """
    named = units.select(*by, num, den, F.coalesce(F.concat(F.lit(":"), F.col(key).cast("string")), F.lit("")).alias("unit"))
    # a unit is one small row and `replicates` draws, so rows are spread by number and not by size
    named = named.repartition(4 * units.sparkSession.sparkContext.defaultParallelism)
    drawn = named.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("digest", F.md5(F.concat(F.lit(f"{seed}:"), F.col("r").cast("string"), "unit")))
    drawn = drawn.select(*by, "r", num, den, poisson_weight(F.col("digest")).alias("w"))
    each = drawn.groupBy(*by, "r").agg((F.sum(F.col("w") * F.col(num)) / F.nullif(F.sum(F.col("w") * F.col(den)), F.lit(0))).alias("x"))
    spread = each.groupBy(*by).agg(F.expr("percentile(x, array(0.025, 0.975))").alias("q"))
    point = units.groupBy(*by).agg((F.sum(num) / F.sum(den)).alias("estimate"), F.count("*").alias("n_units"))
    joined = point.join(spread, by) if by else point.crossJoin(spread)
    some = F.col("n_units") >= 2
    return joined.select(*by, "estimate", F.when(some, F.col("q")[0]).alias("low"), F.when(some, F.col("q")[1]).alias("high"))


def t_quantile(p: float, df: int) -> float:
    """Student's quantile by bisection on the regularised incomplete beta function (continued fraction)."""

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        f = c = 1.0
        d = 0.0
        for i in range(300):
            m = i // 2
            top = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            f *= c * d
            if abs(1 - c * d) < 1e-14:
                break
        return front * (f - 1)

    cdf = lambda t: 1 - 0.5 * beta(df / 2, 0.5, df / (df + t * t)) if t >= 0 else 0.5 * beta(df / 2, 0.5, df / (df + t * t))
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2
