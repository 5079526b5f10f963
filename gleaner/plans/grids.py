"""Lookup tables as arrays: resampled, canonical, and as Hald images.  Suppliers' tables of nine nodes stand for sources'."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.color import ADOBE_GAMMA, lab_sql
from ..operators import grids as R
from ..operators import measure as M
from ..registry import query
from .color import _NODES, N, _tables

ODD = 6  #: nodes that don't fall on those of the source
CANONICAL = 17
_WIDE = "lut % 3 = 0"
_OUTSIDE = "lut % 4 = 1"  #: tables with values out of range


def _corners(targets: str, at: str, key: str) -> str:
    """Trilinear interpolation of nodes n at targets (lut, key, u, v, w in [0, 1])."""
    low = ", ".join(f"least(floor({c} * {N - 1}), {N - 2}) AS i{c}, {c} * {N - 1} - least(floor({c} * {N - 1}), {N - 2}) AS f{c}" for c in "uvw")
    weight = " * ".join(f"(CASE WHEN d{c} = 1 THEN f{c} ELSE 1 - f{c} END)" for c in "uvw")
    return f"{at}q AS (SELECT *, {low} FROM {targets}), {at}k AS (SELECT lut, {key}, iu + du AS r, iv + dv AS g, iw + dw AS b, {weight} AS k FROM {at}q, range(2) a(du), range(2) e(dv), range(2) o(dw)), {at} AS (SELECT lut, {key}, {', '.join(f'sum(k * {c}) AS {c}' for c in 'xyz')} FROM {at}k JOIN n USING (lut, r, g, b) GROUP BY ALL)"


def _arrays(spark, sf_dir):
    return R.gathered(_tables(spark, sf_dir), "lut", N)


@query(
    f"""WITH {_NODES}, t AS (SELECT s_suppkey AS lut, i, j, k AS l, i / {ODD - 1}.0 AS u, j / {ODD - 1}.0 AS v, k / {ODD - 1}.0 AS w FROM supplier, range({ODD}) a(i), range({ODD}) c(j), range({ODD}) d(k)), {_corners("t", "m", "i, j, l")}
    SELECT lut, i AS r, j AS g, l AS b, {", ".join(f"round({c}, 6) AS {c}" for c in "xyz")} FROM m"""
)
def resampled_tables(spark, sf_dir):
    """Each table at a number of nodes that doesn't divide its own."""
    return R.spread(R.resampled(_arrays(spark, sf_dir), "lut", ODD), "lut").select("lut", "r", "g", "b", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"WITH {_NODES} SELECT lut, count(*) AS nodes, sum(round_even(255 * greatest(least(x, 1), 0), 0) + 1000 * round_even(255 * greatest(least(y, 1), 0), 0))::BIGINT AS steps, true AS near FROM n GROUP BY lut")
def hald_round_trip(spark, sf_dir):
    """Each table written as a Hald PNG and read back, in steps of 1 / 255; near: no node is off by more than half a step."""
    own = _arrays(spark, sf_dir)
    back = R.from_hald(R.to_hald(own, "lut", 3), "lut")
    both = back.join(own.select("lut", F.col("values").alias("own")), "lut")
    near = F.forall(F.zip_with("values", "own", lambda a, b: F.abs(a - F.greatest(F.lit(0.0), F.least(F.lit(1.0), b)))), lambda d: d <= 0.5 / 255 + 1e-9)
    rows = R.spread(both.select("lut", "n", "values"), "lut").groupBy("lut").agg(F.count("*").alias("nodes"), F.sum(F.rint(F.col("x") * 255) + 1000 * F.rint(F.col("y") * 255)).cast("long").alias("steps"))
    return rows.join(both.select("lut", near.alias("near")), "lut")


def _matrix_sql(m: np.ndarray, of: str) -> str:
    return ", ".join(f"least(greatest({' + '.join(f'({v!r}) * {c}' for v, c in zip(row.tolist(), of))}, 0), 1) AS {c}" for row, c in zip(m, of))


_M = CANONICAL - 1
_CANONICAL = f"""{_NODES.replace("n AS (", "n0 AS (", 1)}, n AS (SELECT lut, r, g, b, {", ".join(f"least(greatest({c} + CASE WHEN {_OUTSIDE} THEN 0.05 ELSE 0 END, 0), 1) AS {c}" for c in "xyz")} FROM n0),
    s AS (SELECT s_suppkey AS lut, i, j, k AS l, i / {_M}.0 AS u, j / {_M}.0 AS v, k / {_M}.0 AS w FROM supplier, range({CANONICAL}) a(i), range({CANONICAL}) c(j), range({CANONICAL}) d(k)),
    s1 AS (SELECT lut, i, j, l, {", ".join(f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END AS {c}" for c in "uvw")} FROM s WHERE {_WIDE}),
    s2 AS (SELECT lut, i, j, l, {_matrix_sql(R._WIDEN, "uvw")} FROM s1), s3 AS (SELECT lut, i, j, l, {", ".join(f"pow({c}, {1 / ADOBE_GAMMA!r}) AS {c}" for c in "uvw")} FROM s2),
    t AS (SELECT * FROM s3 UNION ALL SELECT * FROM s WHERE NOT {_WIDE}), {_corners("t", "m", "i, j, l")},
    m1 AS (SELECT lut, i, j, l, {", ".join(f"pow(greatest({c}, 0), {ADOBE_GAMMA!r}) AS {c}" for c in "xyz")} FROM m WHERE {_WIDE}), m2 AS (SELECT lut, i, j, l, {_matrix_sql(np.linalg.inv(R._WIDEN), "xyz")} FROM m1),
    o AS (SELECT lut, i, j, l, {", ".join(f"CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, {1 / 2.4!r}) - 0.055 END AS {c}" for c in "xyz")} FROM m2 UNION ALL SELECT lut, i, j, l, x, y, z FROM m WHERE NOT {_WIDE}),
    c AS (SELECT lut, bool_or(x < 0 OR x > 1 OR y < 0 OR y > 1 OR z < 0 OR z > 1) AS clipped FROM (SELECT lut, {", ".join(f"{c} + CASE WHEN {_OUTSIDE} THEN 0.05 ELSE 0 END AS {c}" for c in "xyz")} FROM n0) GROUP BY lut)"""


@query(f"WITH {_CANONICAL} SELECT lut, {CANONICAL} AS n, any_value(clipped) AS clipped, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(sqrt(avg(((x - i / {_M}.0) ** 2 + (y - j / {_M}.0) ** 2 + (z - l / {_M}.0) ** 2) / 3)), 6) AS rms FROM o JOIN c USING (lut) GROUP BY lut")
def canonical_tables(spark, sf_dir):
    """Tables of two colour spaces, some out of range, on the canonical grid: means of their channels and size of their residual."""
    nodes = _tables(spark, sf_dir).select("lut", "r", "g", "b", *[(F.col(c) + F.when(F.expr(_OUTSIDE), 0.05).otherwise(0.0)).alias(c) for c in "xyz"])
    found = R.canonical(R.gathered(nodes, "lut", N).withColumn("wide", F.expr(_WIDE)), "lut", "wide", CANONICAL)
    rms = F.sqrt(F.aggregate("residual", F.lit(0.0), lambda s, x: s + x * x) / F.size("residual"))
    means = R.spread(found, "lut").groupBy("lut").agg(*[F.round(F.avg(c), 6).alias(c) for c in "xyz"])
    return found.select("lut", "n", "clipped", F.round(rms, 6).alias("rms")).join(means, "lut").select("lut", "n", "clipped", "x", "y", "z", "rms")


_PROBES = f"""{_NODES}, ramp AS (SELECT s_suppkey AS lut, 'ramp' AS chart, i, 0 AS j, 0 AS l, i / 32.0 AS u, i / 32.0 AS v, i / 32.0 AS w FROM supplier, range(33) a(i)),
    cube AS (SELECT s_suppkey AS lut, 'cube' AS chart, i, j, k AS l, 0.05 + i * 0.225 AS u, 0.05 + j * 0.225 AS v, 0.05 + k * 0.225 AS w FROM supplier, range(5) a(i), range(5) c(j), range(5) d(k) WHERE greatest(i, j, k) > least(i, j, k)),
    t AS (SELECT * FROM ramp UNION ALL SELECT * FROM cube), {_corners("t", "m", "chart, i, j, l")},
    old AS (SELECT lut, chart, i, j, l AS o, u, {lab_sql("u", "v", "w")} FROM t), new AS (SELECT lut, chart, i, j, l AS o, {lab_sql("x", "y", "z")} FROM m),
    d AS (SELECT old.lut, chart, u, old.l AS l0, new.l AS l1, new.a - old.a AS da, new.b - old.b AS db, sqrt(new.a ** 2 + new.b ** 2) - sqrt(old.a ** 2 + old.b ** 2) AS gain FROM old JOIN new USING (lut, chart, i, j, o)),
    r AS (SELECT lut, avg(db) AS temperature_delta_b, avg(da) AS tint_delta_a, avg(l1 - l0) AS mean_l_delta, quantile_cont(l1, 0.95) - quantile_cont(l1, 0.05) - quantile_cont(l0, 0.95) + quantile_cont(l0, 0.05) AS contrast_l_spread_delta,
      avg(l1 - l0) FILTER (u <= 0.25) AS black_point_l_delta, avg(l1 - l0) FILTER (u >= 0.75) AS highlight_l_delta FROM d WHERE chart = 'ramp' GROUP BY lut),
    c AS (SELECT lut, avg(gain) AS chroma_delta, coalesce(sqrt(avg(da) FILTER (l0 <= 33) ** 2 + avg(db) FILTER (l0 <= 33) ** 2), 0) + coalesce(sqrt(avg(da) FILTER (l0 >= 66) ** 2 + avg(db) FILTER (l0 >= 66) ** 2), 0) AS split_tone_strength FROM d WHERE chart = 'cube' GROUP BY lut)"""
_MEASURED = ("temperature_delta_b", "tint_delta_a", "mean_l_delta", "contrast_l_spread_delta", "black_point_l_delta", "highlight_l_delta", "chroma_delta", "split_tone_strength", "matte_strength")


@query(
    f"""WITH {_PROBES}, z AS (SELECT *, greatest(0, black_point_l_delta) + greatest(0, -contrast_l_spread_delta) + 0.5 * greatest(0, -chroma_delta) AS matte_strength FROM r JOIN c USING (lut))
    SELECT lut, {", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in _MEASURED)} FROM z"""
)
def reduced_behavior(spark, sf_dir):
    """The part of each table's behaviour that scoring reads, on two of the four sets of probes."""
    return M.reduced_behavior(_arrays(spark, sf_dir), "lut").select("lut", *[(F.round(c, 5) + 0.0).alias(c) for c in _MEASURED])
