"""Colour and lookup-table measurement; line items stand in for pixels, supplier keys for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import lut as L
from ..operators import measure as M
from ..registry import query
from ..sources.tables import table

#: a pixel's channels from a line item
PIXEL = {"u": "l_quantity / 50.0", "v": "l_discount * 10.0", "w": "(l_partkey % 101) / 100.0"}
_PIX = "p AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in PIXEL.items()) + " FROM lineitem)"
_LAB = f"{_PIX}, lab AS (SELECT l_orderkey, l_linenumber, u, v, w, {C.lab_sql('u', 'v', 'w')} FROM p)"


def _pixels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).cast("double").alias(c) for c, e in PIXEL.items()])


def _lab(spark, sf_dir) -> DataFrame:
    return C.with_lab(_pixels(spark, sf_dir), ("u", "v", "w"), ("l", "a", "b"))


@query(f"WITH {_LAB} SELECT l_orderkey, l_linenumber, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM lab")
def srgb_to_lab(spark, sf_dir):
    return _lab(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in "lab"])


_HUE = "(((degrees(atan2(b, a)) % 360) + 360) % 360)"
_SECTOR = "list_min([" + ", ".join(f"{{'d': round(abs((((hue - {c} + 180) % 360) + 360) % 360 - 180), 9), 'ord': {i}, 'name': '{s}'}}" for i, (s, c) in enumerate(C.SECTORS.items())) + "]).name"


@query(f"WITH {_LAB}, h AS (SELECT l_orderkey, l_linenumber, sqrt(a * a + b * b) AS chroma, {_HUE} AS hue FROM lab) SELECT {_SECTOR} AS sector, l_orderkey, l_linenumber, round(chroma, 5) AS chroma FROM h")
def hue_sector(spark, sf_dir):
    return _lab(spark, sf_dir).select(C.sector(C.hue(F.col("a"), F.col("b"))).alias("sector"), "l_orderkey", "l_linenumber", F.round(F.hypot("a", "b"), 5).alias("chroma"))


_TURNED = lambda a, b: f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 0 ELSE ((degrees(atan2({b}, {a})) % 360) + 360) % 360 END)"
_COS = lambda x: f"cos(radians({x}))"
_CIEDE = f"""{_LAB}, swapped AS (SELECT l_orderkey, l_linenumber, l AS l1, a AS a1, b AS b1, w, v, u FROM lab),
two AS (SELECT l_orderkey, l_linenumber, l1, a1, b1, l AS l2, a AS a2, b AS b2 FROM (SELECT l_orderkey, l_linenumber, l1, a1, b1, {C.lab_sql('w', 'v', 'u')} FROM swapped)),
s1 AS (SELECT *, ((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2) ** 7 AS c7 FROM two),
s2 AS (SELECT *, 1.5 - 0.5 * sqrt(c7 / (c7 + 25.0 ** 7)) AS g FROM s1),
s3 AS (SELECT *, sqrt(a1 * a1 * g * g + b1 * b1) AS k1, sqrt(a2 * a2 * g * g + b2 * b2) AS k2, {_TURNED('a1 * g', 'b1')} AS h1, {_TURNED('a2 * g', 'b2')} AS h2 FROM s2),
s4 AS (SELECT *, CASE WHEN k1 * k2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
  CASE WHEN k1 * k2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, ((l1 + l2) / 2 - 50) ** 2 AS l5, (k1 + k2) / 2 AS km FROM s3),
s5 AS (SELECT *, 1 - 0.17 * {_COS('hm - 30')} + 0.24 * {_COS('2 * hm')} + 0.32 * {_COS('3 * hm + 6')} - 0.20 * {_COS('4 * hm - 63')} AS t FROM s4),
s6 AS (SELECT *, (l2 - l1) / (1 + 0.015 * l5 / sqrt(20 + l5)) AS sl, (k2 - k1) / (1 + 0.045 * km) AS sc, 2 * sqrt(k1 * k2) * sin(radians(dh / 2)) / (1 + 0.015 * km * t) AS sh,
  -2 * sqrt(km ** 7 / (km ** 7 + 25.0 ** 7)) * sin(radians(60 * exp(-(((hm - 275) / 25) ** 2)))) AS rt FROM s5)"""


@query(f"WITH {_CIEDE} SELECT l_orderkey, l_linenumber, round(sqrt(greatest(0, sl * sl + sc * sc + sh * sh + rt * sc * sh)), 4) AS de FROM s6")
def ciede2000(spark, sf_dir):
    """Difference of each pixel's colour from the same colour with red and blue exchanged."""
    rows = C.with_lab(_lab(spark, sf_dir), ("w", "v", "u"), ("l2", "a2", "b2"))
    return C.with_ciede2000(rows, ("l", "a", "b"), ("l2", "a2", "b2")).select("l_orderkey", "l_linenumber", F.round("de", 4).alias("de"))


N = 9
#: output of table k's node: a curve on red, a twist on green, a fold in some tables on blue
NODE = {"x": "pow(r / 8.0, 0.8 + (lut % 5) * 0.1)", "y": "least(1.0, g / 8.0 + r * 0.002 * (lut % 3))", "z": "CASE WHEN lut % 4 = 0 AND b = 5 THEN b / 8.0 - 0.2 ELSE b / 8.0 END"}
_NODES = "n AS (SELECT s_suppkey AS lut, r, g, b, " + ", ".join(f"{{{c}}} AS {c}" for c in NODE) + " FROM supplier, range(9) x(r), range(9) y(g), range(9) z(b))"
_NODES = _NODES.format(**{c: e.replace("lut", "s_suppkey") for c, e in NODE.items()})


def _tables(spark, sf_dir) -> DataFrame:
    """Each supplier's lookup table, one row a node: the grid is fixed (729 nodes) and goes with the suppliers."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lut")).crossJoin(F.broadcast(L.grid(spark, N))).select("lut", "r", "g", "b", *[F.expr(e).cast("double").alias(c) for c, e in NODE.items()])


@query(f"WITH {_NODES} SELECT lut, round(sqrt(avg(((x - r / 8.0) ** 2 + (y - g / 8.0) ** 2 + (z - b / 8.0) ** 2) / 3)), 6) AS rms FROM n GROUP BY lut")
def residual_rms(spark, sf_dir):
    return L.residual_rms(_tables(spark, sf_dir), N, ["lut"]).withColumn("rms", F.round("rms", 6))


@query(
    f"""WITH {_NODES}, m AS (SELECT *, (x + y + z) / 3 AS m FROM n), d AS (SELECT lut, lead(m) OVER (PARTITION BY lut, g, b ORDER BY r) - m AS d FROM m
    UNION ALL SELECT lut, lead(m) OVER (PARTITION BY lut, r, b ORDER BY g) - m FROM m UNION ALL SELECT lut, lead(m) OVER (PARTITION BY lut, r, g ORDER BY b) - m FROM m)
    SELECT lut, round(avg((d < -0.02)::INTEGER), 6) AS rate FROM d WHERE d IS NOT NULL GROUP BY lut"""
)
def foldover(spark, sf_dir):
    return L.foldover(_tables(spark, sf_dir), ["lut"]).withColumn("rate", F.round("rate", 6))


_D2 = lambda axis, rest: "SELECT lut, unnest([" + ", ".join(f"abs(lead({c} - {p} / 8.0) OVER w - 2 * ({c} - {p} / 8.0) + lag({c} - {p} / 8.0) OVER w)" for c, p in zip("xyz", "rgb")) + f"]) AS s FROM n WINDOW w AS (PARTITION BY lut, {rest} ORDER BY {axis})"


@query(f"WITH {_NODES}, d AS ({_D2('r', 'g, b')} UNION ALL {_D2('g', 'r, b')} UNION ALL {_D2('b', 'r, g')}) SELECT lut, round(quantile_cont(s, 0.99) * 0.25, 6) AS p FROM d WHERE s IS NOT NULL GROUP BY lut")
def second_diff_p99(spark, sf_dir):
    return L.second_difference(_tables(spark, sf_dir), N, ["lut"]).withColumn("p", F.round("p", 6))


_AXIS = lambda c: f"least(greatest({c}, 0), 1) * 8"


@query(
    f"""WITH {_PIX}, n AS (SELECT r, g, b, {", ".join(e.replace('lut', '1') + f" AS {c}" for c, e in NODE.items())} FROM range(9) x(r), range(9) y(g), range(9) z(b)),
    q AS (SELECT l_orderkey, l_linenumber, {", ".join(f"least(floor({_AXIS(c)}), 7) AS i{c}, {_AXIS(c)} - least(floor({_AXIS(c)}), 7) AS f{c}" for c in "uvw")} FROM p),
    k AS (SELECT l_orderkey, l_linenumber, iu + du AS r, iv + dv AS g, iw + dw AS b, (CASE WHEN du = 1 THEN fu ELSE 1 - fu END) * (CASE WHEN dv = 1 THEN fv ELSE 1 - fv END) * (CASE WHEN dw = 1 THEN fw ELSE 1 - fw END) AS k FROM q, range(2) a(du), range(2) e(dv), range(2) c(dw))
    SELECT l_orderkey, l_linenumber, round(sum(k * x), 6) AS x, round(sum(k * y), 6) AS y, round(sum(k * z), 6) AS z FROM k JOIN n USING (r, g, b) GROUP BY l_orderkey, l_linenumber"""
)
def trilinear_apply(spark, sf_dir):
    nodes = L.grid(spark, N).select("r", "g", "b", *[F.expr(e.replace("lut", "1")).cast("double").alias(c) for c, e in NODE.items()])
    return L.apply_trilinear(_pixels(spark, sf_dir), nodes, N, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(
    f"""WITH {_PIX}, c AS (SELECT round_even(least(greatest(u, 0), 1) * 8, 0) AS r, round_even(least(greatest(v, 0), 1) * 8, 0) AS g, round_even(least(greatest(w, 0), 1) * 8, 0) AS b, count(*) AS k FROM p GROUP BY ALL)
    SELECT round(count(*) FILTER (k >= 32) / count(*)::DOUBLE, 6) AS supported_cell_rate, round(coalesce(sum(k) FILTER (k >= 32), 0) / sum(k)::DOUBLE, 6) AS input_pixel_supported_rate FROM c"""
)
def support_rates(spark, sf_dir):
    return L.support(_pixels(spark, sf_dir), N).select(*[F.round(c, 6).alias(c) for c in ("supported_cell_rate", "input_pixel_supported_rate")])


@query(f"WITH {_NODES} SELECT lut, count(*) FILTER (r IN (0, 8) OR g IN (0, 8) OR b IN (0, 8)) AS boundary, round(avg(abs(z - b / 8.0)) FILTER (r IN (0, 8) OR g IN (0, 8) OR b IN (0, 8)), 6) AS boundary_mean, round(avg(abs(z - b / 8.0)) FILTER (r NOT IN (0, 8) AND g NOT IN (0, 8) AND b NOT IN (0, 8)), 6) AS interior_mean FROM n GROUP BY lut")
def boundary_nodes(spark, sf_dir):
    """Errors on the cube's faces and inside."""
    face = F.expr("r IN (0, 8) OR g IN (0, 8) OR b IN (0, 8)")
    error = F.abs(F.col("z") - F.col("b") / (N - 1))
    return _tables(spark, sf_dir).groupBy("lut").agg(F.count_if(face).alias("boundary"), F.round(F.avg(F.when(face, error)), 6).alias("boundary_mean"), F.round(F.avg(F.when(~face, error)), 6).alias("interior_mean"))


@query(f"WITH {_NODES} SELECT lut, count(*) AS rows, round(sum(x), 5) AS x FROM n GROUP BY lut")
def cube_roundtrip(spark, sf_dir):
    """Each table written as .cube text and read back."""
    texts = L.serialize_cube(_tables(spark, sf_dir).withColumn("n", F.lit(N)), "lut")
    back = L.parse_cube(texts.select(F.col("lut").alias("name"), "content"))
    return back.groupBy(F.col("name").alias("lut")).agg(F.count("*").alias("rows"), F.round(F.sum("x"), 5).alias("x"))


@query(f"WITH {_LAB} SELECT l_orderkey % 50 AS image, round(avg(u), 6) AS mean_u, round(stddev_pop(u), 6) AS std_u, round(regr_r2(l, u), 6) AS r2, round(abs(corr(l, v)), 6) AS corr_v FROM lab GROUP BY 1")
def image_statistics(spark, sf_dir):
    """Channel means and deviations, explained variance and correlation per image."""
    rows = _lab(spark, sf_dir).withColumn("image", F.col("l_orderkey") % 50)
    return rows.groupBy("image").agg(F.round(F.avg("u"), 6).alias("mean_u"), F.round(F.stddev_pop("u"), 6).alias("std_u"), F.round(F.regr_r2("l", "u"), 6).alias("r2"), F.round(F.abs(F.corr("l", "v")), 6).alias("corr_v"))


@query(f"WITH {_LAB} SELECT l_orderkey, l_linenumber, round(u, 5) AS u, round(v, 5) AS v, round(w, 5) AS w FROM lab")
def lab_round_trip(spark, sf_dir):
    """To Lab and back gives the colour itself."""
    return C.with_srgb(_lab(spark, sf_dir), ("l", "a", "b"), ("u2", "v2", "w2")).select("l_orderkey", "l_linenumber", *[F.round(c + "2", 5).alias(c) for c in "uvw"])


@query()
def behavior_vectors(spark, sf_dir):
    """The measured behaviour of each table, one row a table."""
    return M.behavior(_tables(spark, sf_dir), N, "lut")


@query()
def smooth_fill(spark, sf_dir):
    """Pixels fitted to nodes and diffused over the grid, per line number."""
    pixels = _pixels(spark, sf_dir).select(F.col("l_linenumber").alias("lut"), "u", "v", "w", F.pow("u", F.lit(0.9)).alias("x"), F.col("v").alias("y"), F.col("w").alias("z"))
    return M.smooth_fill(M.scattered_fit(pixels, 5, "lut"), 5, "lut").select("lut", "r", "g", "b", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(
    f"""WITH {_PIX} SELECT l_linenumber AS lut, round_even(least(greatest(u, 0), 1) * 4, 0)::INTEGER AS r, round_even(least(greatest(v, 0), 1) * 4, 0)::INTEGER AS g, round_even(least(greatest(w, 0), 1) * 4, 0)::INTEGER AS b, count(*) AS k, round(avg(v), 6) AS y FROM p GROUP BY ALL"""
)
def scattered_fit(spark, sf_dir):
    """Mean target of the pixels nearest to each node."""
    pixels = _pixels(spark, sf_dir).select(F.col("l_linenumber").alias("lut"), "u", "v", "w", F.col("u").alias("x"), F.col("v").alias("y"), F.col("w").alias("z"))
    return M.scattered_fit(pixels, 5, "lut").select("lut", "r", "g", "b", "k", F.round("y", 6).alias("y"))


@query()
def procedural_catalog(spark, sf_dir):
    """The generated tables of every attribute at three strengths, nine nodes an axis."""
    return M.procedural(spark, 9).select("name", "r", "g", "b", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"WITH {_NODES} SELECT lut, round(avg(e), 6) AS mean, round(least(120, CASE WHEN avg(q) <= 1e-20 THEN 120 ELSE 10 * log10(1 / avg(q)) END), 4) AS psnr FROM (SELECT lut, abs(z - b / 8.0) AS e, ((x - r / 8.0) ** 2 + (y - g / 8.0) ** 2 + (z - b / 8.0) ** 2) / 3 AS q FROM n) GROUP BY lut")
def table_psnr(spark, sf_dir):
    """Mean error and signal-to-noise ratio of each table against the identity."""
    res = L.residual(_tables(spark, sf_dir), N)
    mse = F.avg((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")) / 3)
    return res.groupBy("lut").agg(F.round(F.avg(F.abs("dz")), 6).alias("mean"), F.round(F.when(mse <= 1e-20, 120.0).otherwise(F.least(F.lit(120.0), 10 * F.log10(1 / mse))), 4).alias("psnr"))
