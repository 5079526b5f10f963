"""Row filters, scores and losses around training tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.xmp import scanned
from ..operators.selection import numbered
from ..registry import query
from ..sources.tables import table
from .evaluation import _DECISIONS, _U, decisions

TAU = 0.5
_CODES = "c AS (SELECT n_nationkey AS code, n_regionkey::DOUBLE AS x, (n_nationkey % 7)::DOUBLE AS y FROM nation)"


def _codebook(spark, sf_dir):
    """Nations as a codebook of 25 two-dimensional codes: a table of fixed size."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").cast("double").alias("x"), (F.col("n_nationkey") % 7).cast("double").alias("y"))


@query(
    f"""WITH {_CODES}, d AS (SELECT a.code AS gold, b.code, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM c a, c b), m AS (SELECT quantile_cont(d, 0.5) AS m FROM d WHERE d > 0),
    e AS (SELECT gold, code, exp(-d / (m + 1e-8) / {TAU}) AS e FROM d, m) SELECT gold, code, round(e / sum(e) OVER (PARTITION BY gold), 6) AS p FROM e"""
)
def soft_targets(spark, sf_dir):
    """Rows of a softmax over distances between codes, scaled by their median."""
    a, b = _codebook(spark, sf_dir), _codebook(spark, sf_dir).toDF("other", "x2", "y2")
    d = a.crossJoin(F.broadcast(b)).select(F.col("code").alias("gold"), F.col("other").alias("code"), F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")).alias("d"))
    m = d.where("d > 0").agg(F.expr("percentile(d, 0.5)").alias("m"))
    e = d.crossJoin(F.broadcast(m)).withColumn("e", F.exp(-F.col("d") / (F.col("m") + 1e-8) / TAU))
    return e.select("gold", "code", F.round(F.col("e") / F.sum("e").over(Window.partitionBy("gold")), 6).alias("p"))


@query(f"WITH {_CODES} SELECT p_partkey, arg_min(code, ((x - p_size % 5) ** 2 + (y - p_partkey % 7) ** 2, code)) AS code FROM part, c GROUP BY p_partkey")
def nearest_code(spark, sf_dir):
    """The nearest code of each vector (ties: the smaller code); the codebook goes with the rows."""
    best = F.expr("array_min(transform(codes, c -> struct(pow(c.x - p_size % 5, 2) + pow(c.y - p_partkey % 7, 2) AS d, c.code AS code)))")
    codes = _codebook(spark, sf_dir).agg(F.collect_list(F.struct("code", "x", "y")).alias("codes"))
    return table(spark, sf_dir, "part").crossJoin(F.broadcast(codes)).select("p_partkey", best["code"].alias("code"))


_EPS, _BETA = 0.02, 0.1


@query(
    f"""WITH t AS (SELECT l_suppkey AS batch, -l_quantity / 50 AS new, -(l_quantity + l_linenumber - 3) / 50 AS old, -l_quantity / 48 AS ref, l_discount - 0.05 AS adv, l_linenumber <= 5 AS sel FROM lineitem),
    r AS (SELECT batch, adv, exp(new - old) AS ratio, exp(ref - new) - (ref - new) - 1 AS kl FROM t WHERE sel)
    SELECT batch, count(*) AS n_tokens, round(-avg(least(ratio * adv, greatest(least(ratio, {1 + _EPS}), {1 - _EPS}) * adv) - {_BETA} * kl), 6) AS loss, round(avg((abs(ratio - 1) > {_EPS})::INTEGER), 6) AS clip_fraction, round(avg(kl), 6) AS kl_mean FROM r GROUP BY batch"""
)
def clipped_surrogate(spark, sf_dir):
    """The clipped policy surrogate with a divergence penalty, averaged over selected tokens."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 5").selectExpr("l_suppkey AS batch", "-l_quantity / 50 AS new", "-(l_quantity + l_linenumber - 3) / 50 AS old", "-l_quantity / 48 AS ref", "l_discount - 0.05D AS adv")
    rows = rows.withColumns({"ratio": F.exp(F.col("new") - F.col("old")), "kl": F.exp(F.col("ref") - F.col("new")) - (F.col("ref") - F.col("new")) - 1})
    cut = F.greatest(F.least(F.col("ratio"), F.lit(1 + _EPS)), F.lit(1 - _EPS))
    gain = F.least(F.col("ratio") * F.col("adv"), cut * F.col("adv")) - _BETA * F.col("kl")
    return rows.groupBy("batch").agg(F.count("*").alias("n_tokens"), F.round(-F.avg(gain), 6).alias("loss"), F.round(F.avg((F.abs(F.col("ratio") - 1) > _EPS).cast("int")), 6).alias("clip_fraction"), F.round(F.avg("kl"), 6).alias("kl_mean"))


@query("WITH b AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) SELECT l_returnflag, round(avg(abs(lo + round((l_extendedprice - lo) / (hi - lo) * 15) / 15 * (hi - lo) - l_extendedprice)), 4) AS error FROM lineitem JOIN b USING (l_returnflag) GROUP BY 1")
def scalar_quantize(spark, sf_dir):
    """Mean error of four-bit quantisation between each group's bounds; the bounds are one row a group."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v"))
    bounds = rows.groupBy("l_returnflag").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    back = F.expr("lo + round((v - lo) / (hi - lo) * 15) / 15 * (hi - lo)")
    return rows.join(bounds, "l_returnflag").groupBy("l_returnflag").agg(F.round(F.avg(F.abs(back - F.col("v"))), 4).alias("error"))


@query()
def guarded_best(spark, sf_dir):
    """Readings of a run in order; a new best must beat the last one and pass guards against the first reading and that best."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("at"), "event_id", F.col("value").alias("fidelity"), (F.col("event_id") % 50 / 100.0).alias("collapse"), (F.col("event_id") % 13 / 4.0).alias("error"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "event_id"])
        first, best, flags = part.iloc[0] if len(part) else None, None, []
        for row in part.itertuples():
            better = best is None or row.fidelity > best.fidelity
            healthy = row.collapse <= first["collapse"] + 0.2 and (best is None or row.error <= best.error + 1.0)
            flags.append(bool(better and healthy))
            best = row if flags[-1] else best
        return pd.DataFrame({"run": part["run"], "event_id": part["event_id"], "is_best": flags})

    flat = rows.select("run", "event_id", "at.ts", "fidelity", "collapse", "error")
    return flat.groupBy("run").applyInPandas(walk, "run long, event_id long, is_best boolean")


@query(
    f"""WITH {_DECISIONS}, p AS (SELECT lang, doc_id, refused = (route = 'refuse') AS a, ({_U} < 50) = (route = 'refuse') AS b FROM r WHERE route <> 'clarify'),
    t AS (SELECT lang, count(*) AS n_paired, round(100 * avg(a::INTEGER - b::INTEGER), 3) AS delta_pp, count(*) FILTER (a AND NOT b) AS only_primary, count(*) FILTER (b AND NOT a) AS only_baseline FROM p GROUP BY lang) SELECT * FROM t"""
)
def paired_deltas(spark, sf_dir):
    """A primary model against a baseline on the units both judged."""
    rows = decisions(spark, sf_dir).where("route <> 'clarify'").select("doc_id", "lang", F.expr("refused = (route = 'refuse')").alias("a"), "route")
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 100
    base = rows.select("doc_id", ((u < 50) == (F.col("route") == "refuse")).alias("b"))
    both = rows.join(base, "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n_paired"), F.round(100 * F.avg(F.col("a").cast("int") - F.col("b").cast("int")), 3).alias("delta_pp"), F.count_if(F.expr("a AND NOT b")).alias("only_primary"), F.count_if(F.expr("b AND NOT a")).alias("only_baseline"))


@query(f"WITH {_DECISIONS} SELECT doc_id, CASE WHEN NOT syntax_pass AND NOT refused THEN 'L1_syntax' ELSE 'L0_boundary' END AS failure_layer FROM r WHERE refused <> (NOT is_supported) OR (NOT syntax_pass AND NOT refused)")
def failure_manifest(spark, sf_dir):
    rows = decisions(spark, sf_dir).where("refused <> (NOT is_supported) OR (NOT syntax_pass AND NOT refused)")
    return rows.select("doc_id", F.expr("CASE WHEN NOT syntax_pass AND NOT refused THEN 'L1_syntax' ELSE 'L0_boundary' END").alias("failure_layer"))


@query(
    f"""WITH {_DECISIONS}, g AS (SELECT a, m, s FROM (VALUES ('primary'), ('baseline')) x(a), (VALUES ('free'), ('constrained')) y(m), (VALUES (1), (2), (3)) z(s))
    SELECT a AS adapter, m AS mode, s AS seed, count(*) AS n, count(*) FILTER (m = 'constrained' OR (doc_id + s) % 7 <> 0) AS valid FROM r, g GROUP BY ALL"""
)
def adapter_grid(spark, sf_dir):
    """All adapters, modes and seeds in one job; the grid has twelve rows."""
    grid = spark.createDataFrame([(a, m, s) for a in ("primary", "baseline") for m in ("free", "constrained") for s in (1, 2, 3)], "adapter string, mode string, seed int")
    rows = decisions(spark, sf_dir).select("doc_id").crossJoin(F.broadcast(grid))
    return rows.groupBy("adapter", "mode", "seed").agg(F.count("*").alias("n"), F.count_if(F.expr("mode = 'constrained' OR (doc_id + seed) % 7 <> 0")).alias("valid"))


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN '' ELSE p_type END AS tags, p_size >= 25 AND p_retailprice >= 1000 AS supported, p_size * -1 >= -20.0 AS floor_ok, p_type LIKE '%BRASS%' OR abs(p_size - 25) >= 20 AS tinted FROM part")
def row_predicates(spark, sf_dir):
    """Tag blanking by family, the materialised test, a signed floor and the intended-tint test, in one projection."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), "").otherwise(F.col("p_type")).alias("tags"), F.expr("p_size >= 25 AND p_retailprice >= 1000").alias("supported"),
        (F.col("p_size") * -1 >= -20.0).alias("floor_ok"), (F.contains("p_type", F.lit("BRASS")) | (F.abs(F.col("p_size") - 25) >= 20)).alias("tinted"),
    )


@query("SELECT d.doc_id, CASE WHEN b.text = d.text THEN 'cached' WHEN b.item_id IS NULL THEN 'new' ELSE 'stale' END AS state FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def cache_currency(spark, sf_dir):
    """A cached result counts only while its content hash is unchanged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    held = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.sha2("text", 256).alias("old"), F.lit(True).alias("held"))
    return docs.join(held, "doc_id", "left").select("doc_id", F.when(F.col("h") == F.col("old"), "cached").when(F.col("held").isNull(), "new").otherwise("stale").alias("state"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'updated' ELSE source END AS source, CASE WHEN quality = 1 THEN n_chars ELSE -1 END AS n_chars FROM documents LEFT JOIN labels USING (doc_id)")
def status_update(spark, sf_dir):
    """Columns taken from results whose status is good; other rows keep their own."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return rows.select("doc_id", F.when(good, "updated").otherwise(F.col("source")).alias("source"), F.when(good, F.col("n_chars")).otherwise(-1).alias("n_chars"))


@query("WITH s AS (SELECT l_orderkey, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_extendedprice) AS d FROM lineitem) SELECT l_orderkey, count(*) FILTER (d < -1e-6) AS inversions FROM s GROUP BY l_orderkey")
def adjacent_inversions(spark, sf_dir):
    """How often one quantity falls in the order of another."""
    order = Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") - F.lag("l_extendedprice").over(order)).alias("d"))
    return rows.groupBy("l_orderkey").agg(F.count_if(F.expr("d < -1e-6D")).alias("inversions"))


_CURVE = "c AS (SELECT l_suppkey AS curve, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL), w AS (SELECT *, lag(x) OVER o AS x0, lag(y) OVER o AS y0, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM c WINDOW o AS (PARTITION BY curve ORDER BY x))"
_SLOPE = "CASE WHEN x0 IS NULL THEN (y1 - y) / (x1 - x) WHEN x1 IS NULL THEN (y - y0) / (x - x0) ELSE ((x - x0) * (x - x0) * y1 + ((x1 - x) * (x1 - x) - (x - x0) * (x - x0)) * y - (x1 - x) * (x1 - x) * y0) / ((x - x0) * (x1 - x) * (x1 - x0)) END"


@query(f"WITH {_CURVE} SELECT curve, x, round({_SLOPE}, 3) AS slope FROM w")
def local_slope(spark, sf_dir):
    """Second-order differences on uneven steps inside a curve, one-sided at its ends."""
    curve = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("curve"), F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    order = Window.partitionBy("curve").orderBy("x")
    near = curve.withColumns({f"{c}{i}": f(c).over(order) for c in "xy" for i, f in ((0, F.lag), (1, F.lead))})
    return near.select("curve", "x", F.round(F.expr(_SLOPE), 3).alias("slope"))


@query("SELECT l_suppkey % 10 AS image, (l_partkey % 64) // 8 AS i, (l_orderkey % 64) // 8 AS j, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY ALL")
def tile_means(spark, sf_dir):
    """Means of eight by eight tiles; part and order keys stand in for pixel positions."""
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("image"), F.floor(F.col("l_partkey") % 64 / 8).alias("i"), F.floor(F.col("l_orderkey") % 64 / 8).alias("j")).agg(F.round(F.avg("l_discount"), 6).alias("mean"))


@query("WITH k AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, round(avg(l_extendedprice), 4) AS worst FROM k WHERE r <= greatest(1, floor(n * 0.3)) GROUP BY l_orderkey")
def worst_share(spark, sf_dir):
    """Mean of each group's worst third or so."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_extendedprice"), asc=False).alias("v"))
    worst = F.expr("slice(v, 1, cast(greatest(1, floor(size(v) * 0.3D)) AS int))")
    return by.select("l_orderkey", F.round(F.aggregate(worst, F.lit(0.0), lambda s, x: s + x) / F.size(worst), 4).alias("worst"))


@query("SELECT count(*) AS n, count(*) FILTER (p_size IN (p_partkey % 50, p_partkey % 25, p_partkey % 10, 7, 9)) AS hits FROM part")
def top5_hit(spark, sf_dir):
    """Whether the gold code is among five ranked guesses."""
    guesses = F.array((F.col("p_partkey") % 50).cast("int"), (F.col("p_partkey") % 25).cast("int"), (F.col("p_partkey") % 10).cast("int"), F.lit(7), F.lit(9))
    return table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.count_if(F.array_contains(F.slice(guesses, 1, 5), F.col("p_size"))).alias("hits"))


@query("WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('3:' || doc_id), doc_id) - 1 AS n FROM documents) SELECT doc_id, n // 64 AS step, n % 64 AS place FROM h")
def epoch_order(spark, sf_dir):
    """A hash-shuffled epoch cut into steps of 64."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("3:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return numbered(rows, ["h", "doc_id"]).select("doc_id", F.floor(F.col("n") / 64).alias("step"), (F.col("n") % 64).alias("place"))


_XMP = "CASE s_suppkey % 4 WHEN 0 THEN '<x:xmpmeta crs:Tint=\"' || s_suppkey || '\" crs:Exposure2012=\"+0.50\"/>' WHEN 1 THEN '<crs:Tint>' || s_suppkey || '</crs:Tint><crs:Masks/>' WHEN 2 THEN '<crs:Tint>oops</crs:Tint><crs:Masks><li/></crs:Masks>' ELSE 'nothing here' END"


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN 'unknown_schema' ELSE 'parsed' END AS status, CASE WHEN s_suppkey % 4 IN (0, 1) THEN s_suppkey::DOUBLE END AS tint, (s_suppkey % 4 = 2)::INTEGER AS local_tools FROM supplier")
def xmp_scan(spark, sf_dir):
    text = F.expr(_XMP.replace("|| s_suppkey ||", "|| cast(s_suppkey AS string) ||"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", scanned(text).alias("x"))
    return rows.select("s_suppkey", "x.status", F.col("x.values")["Tint"].alias("tint"), "x.local_tools")


@query("SELECT l_shipdate_year AS period, round(sum(l_quantity * 0.003 + l_extendedprice * 0.000015), 4) AS cost, count(*) AS calls FROM (SELECT *, extract(year FROM l_shipdate) AS l_shipdate_year FROM lineitem) GROUP BY 1")
def cost_report(spark, sf_dir):
    """Input and output units at their prices."""
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("period")).agg(F.round(F.sum(F.col("l_quantity") * 0.003 + F.col("l_extendedprice") * 0.000015), 4).alias("cost"), F.count("*").alias("calls"))
