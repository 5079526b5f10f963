"""Pictures: spatial gates of residuals.  Line items of a supplier, in order, are laid out as a picture's pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import spatial as P
from ..registry import query
from ..sources.tables import table

WIDEST = 24  #: a picture is as wide as the largest divisor of its pixels up to this
_RESIDUAL = "l_discount * 100 + x / 40.0"
_PIXELS = f"""n AS (SELECT l_suppkey AS image, l_discount::DOUBLE AS l_discount, l_quantity::DOUBLE AS luma, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_discount, l_quantity) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
    g AS (SELECT *, list_max(list_filter(range(1, {WIDEST + 1}), lambda d: n % d = 0)) AS w FROM n), q AS (SELECT image, w, n // w AS h, place % w AS x, place // w AS y, l_discount, luma FROM g),
    p AS (SELECT image, w, h, x, y, luma, {_RESIDUAL} AS r FROM q)"""
_NEAR = "SELECT p.image, p.x, p.y, dx, dy, o.luma FROM p, range(-1, 2) a(dx), range(-1, 2) b(dy), p AS o WHERE o.image = p.image AND o.x = least(greatest(p.x + dx, 0), p.w - 1) AND o.y = least(greatest(p.y + dy, 0), p.h - 1)"
_R2 = "CASE WHEN var_pop(r) * count(*) < 1e-9 THEN 0 WHEN var_pop(x) = 0 AND var_pop(y) = 0 THEN 0 WHEN var_pop(x) = 0 THEN regr_r2(r, y) WHEN var_pop(y) = 0 THEN regr_r2(r, x) ELSE (covar_pop(x, r) ** 2 * var_pop(y) - 2 * covar_pop(x, r) * covar_pop(y, r) * covar_pop(x, y) + covar_pop(y, r) ** 2 * var_pop(x)) / (var_pop(x) * var_pop(y) - covar_pop(x, y) ** 2) / var_pop(r) END"


def _corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN stddev_pop({a}) < 1e-9 OR stddev_pop({b}) < 1e-9 THEN 0 ELSE abs(corr({a}, {b})) END"


_MEASURES = f"""{_PIXELS},
    s AS (SELECT image, x, y, sqrt(sum(dx * (2 - abs(dy)) * luma) ** 2 + sum(dy * (2 - abs(dx)) * luma) ** 2) AS edge FROM ({_NEAR}) GROUP BY ALL),
    e AS (SELECT p.*, edge, x / greatest(w - 1, 1)::DOUBLE AS xn, y / greatest(h - 1, 1)::DOUBLE AS yn FROM p JOIN s USING (image, x, y)),
    m AS (SELECT image, any_value(w) AS width, any_value(h) AS height, avg(r) AS global_mean, avg(r) FILTER ((x + y) % 4 = 0) AS mean, quantile_cont(r, 0.95) FILTER ((x + y) % 4 = 0) AS p95, quantile_cont(r, 0.99) FILTER ((x + y) % 4 = 0) AS p99,
      {_R2} AS xy_r2, {_corr_sql('r', 'xn')} AS corr_x, {_corr_sql('r', 'yn')} AS corr_y, {_corr_sql('r', 'sqrt((xn - 0.5) ** 2 + (yn - 0.5) ** 2)')} AS corr_radius, {_corr_sql('r', 'edge')} AS edge_corr FROM e GROUP BY image),
    t AS (SELECT image, quantile_cont(v, 0.95) AS block_p95, max(v) AS block_max FROM (SELECT image, avg(r) AS v FROM p GROUP BY image, y // greatest(h // 8, 1), x // greatest(w // 8, 1)) GROUP BY image),
    k AS (SELECT image, x, y FROM p WHERE r > 6),
    reach(image, s, x, y) AS (SELECT image, y * 100 + x, x, y FROM k UNION SELECT k.image, s, k.x, k.y FROM reach CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(i, j) JOIN k ON k.image = reach.image AND k.x = reach.x + i AND k.y = reach.y + j),
    c AS (SELECT image, max(size) AS size FROM (SELECT image, s, count(*) AS size FROM reach GROUP BY image, s) GROUP BY image),
    z AS (SELECT m.*, block_p95, block_max, coalesce(size, 0) / (width * height)::DOUBLE AS component FROM m JOIN t USING (image) LEFT JOIN c USING (image))"""
_ROUNDED = ("global_mean", "mean", "p95", "p99", "xy_r2", "corr_x", "corr_y", "corr_radius", "edge_corr", "block_p95", "block_max", "component")


def supplier_pixels(spark, sf_dir) -> DataFrame:
    """(image, x, y, residual, luma): every line item is a pixel of its supplier's picture."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image"), F.col("l_discount").cast("double").alias("l_discount"), F.col("l_quantity").cast("double").alias("luma"),
        (F.row_number().over(order) - 1).alias("at"), F.count("*").over(Window.partitionBy("l_suppkey")).alias("n"),
    )
    width = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(WIDEST)), lambda d: F.col("n") % d == 0))
    placed = rows.withColumn("w", width).select("image", (F.col("at") % F.col("w")).alias("x"), F.floor(F.col("at") / F.col("w")).alias("y"), "l_discount", "luma")
    return placed.select("image", "x", "y", F.expr(_RESIDUAL).alias("residual"), "luma")


@query(f"WITH RECURSIVE {_MEASURES} SELECT image, width, height, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM z")
def spatial_residuals(spark, sf_dir):
    """Where each picture's residual sits: place, edges, blocks and its largest connected region."""
    found = P.spatial_measures(supplier_pixels(spark, sf_dir), "image", tile=16)
    return found.select("image", "width", "height", *[F.round(c, 6).alias(c) for c in _ROUNDED])


_HARD = {"fit_mean_exceeded": "mean > 3", "fit_p95_exceeded": "p95 > 7", "fit_p99_exceeded": "p99 > 10", "tile_residual": "block_max > greatest(6.0, 2.5 * global_mean)", "high_residual_component": "component > 0.01"}
_SOFT = {"residual_xy_r2": "xy_r2 > 0.05", "coord_correlation": "greatest(corr_x, corr_y, corr_radius) > 0.25", "edge_correlation": "edge_corr > 0.3"}


@query(f"WITH RECURSIVE {_MEASURES} SELECT image, concat_ws(' ', {', '.join(f'CASE WHEN {t} THEN {n!r} END' for n, t in (_HARD | _SOFT).items())}) AS reasons FROM z")
def spatial_gates(spark, sf_dir):
    """The gates that each picture's fit fails by size and by structure, from measured values."""
    m = {n: F.col(n) for n in ("mean", "p95", "p99", "component", "xy_r2", "edge_corr")}
    m |= {"support": F.lit(1.0), "tile": F.col("block_max"), "global_mean": F.col("global_mean"), "coord_corr": F.greatest("corr_x", "corr_y", "corr_radius")}
    found = P.spatial_measures(supplier_pixels(spark, sf_dir), "image", tile=16)
    return found.select("image", F.array_join(F.concat(G.fit_reasons(m), G.structure_reasons(m)), " ").alias("reasons"))
