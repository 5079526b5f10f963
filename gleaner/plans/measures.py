"""Quality gates, tiers and codebook measures; line items stand in for measured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import split_of, sql_split
from ..operators import gates as G
from ..registry import query
from ..sources.tables import table

#: measurements derived from a line item, alike in both engines
DIRECT = {
    "clip_rate": "l_discount / 12.0", "out_of_range": "l_tax / 2.2", "foldover_rate": "(l_partkey % 11) / 1500.0", "smoothness": "l_quantity / 150.0", "neutral_drift": "(l_suppkey % 9) / 2.0",
    "hue_drift": "(l_partkey % 21) / 2.0", "delta_e": "(l_orderkey % 27) / 2.0", "chroma_low": "0.7 + (l_orderkey % 13) / 20.0", "chroma_high": "0.9 + (l_partkey % 10) / 20.0", "inversions": "CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END",
}
PAIR = {
    "mean": "l_quantity / 14.0", "p95": "l_quantity / 6.5", "p99": "l_quantity / 4.4", "support": "1.0 - (l_partkey % 50) / 2000.0", "tile": "(l_suppkey % 80) / 10.0", "component": "(l_orderkey % 23) / 2100.0",
    "xy_r2": "l_discount", "coord_corr": "(l_partkey % 40) / 100.0", "edge_corr": "(l_suppkey % 45) / 100.0",
}
_TINTED = "l_linestatus = 'F'"
_M = "m AS (SELECT l_orderkey, l_linenumber, " + _TINTED + " AS tinted, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in (DIRECT | PAIR).items()) + " FROM lineitem)"


def _reasons_sql(checks: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in checks.items()) + "], lambda x: x IS NOT NULL)"


_SAFETY = _reasons_sql({"clip_rate_exceeded": "clip_rate > 0.005", "pre_clamp_out_of_range": "out_of_range > 0.03", "foldover": "foldover_rate > 0.005", "smoothness_extreme": "smoothness > 0.3", "neutral_drift": "NOT tinted AND neutral_drift > 3"})
_SKIN = _reasons_sql({"skin_hue_drift": "hue_drift > 8", "skin_deltaE": "delta_e > 12", "skin_chroma_low": "chroma_low < 0.75", "skin_chroma_high": "chroma_high > 1.35", "skin_lightness_order": "inversions > 0"})
_CAP = _reasons_sql({"smoothness": "smoothness > 0.15 AND smoothness <= 0.3"})
_HARD = _reasons_sql({"fit_mean_exceeded": "mean > 3", "fit_p95_exceeded": "p95 > 7", "fit_p99_exceeded": "p99 > 10", "input_support_low": "support < 0.98", "tile_residual": "tile > greatest(6.0, 2.5 * mean)", "high_residual_component": "component > 0.01"})
_STRUCTURE = _reasons_sql({"residual_xy_r2": "xy_r2 > 0.05", "coord_correlation": "coord_corr > 0.25", "edge_correlation": "edge_corr > 0.3"})
_T = f"{_M}, t AS (SELECT *, {_SAFETY} AS safety, {_SKIN} AS skin, {_CAP} AS cap, {_HARD} AS hard, {_STRUCTURE} AS structure FROM m)"
_DIRECT_TIER = "CASE WHEN len(safety) > 0 THEN 'rejected' WHEN len(skin) = 0 AND len(cap) = 0 THEN 'gold' ELSE 'diagnostic_only' END"
_FIT_TIER = "CASE WHEN len(hard) > 0 THEN 'rejected' WHEN mean <= 2.5 AND support >= 0.98 AND len(skin) = 0 AND len(cap) = 0 AND NOT (len(structure) >= 2 OR xy_r2 > 0.08 OR coord_corr > 0.35 OR edge_corr > 0.4) THEN 'gold' ELSE 'diagnostic_only' END"


def _measured(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_TINTED).alias("tinted"), *[F.expr(e).cast("double").alias(n) for n, e in (DIRECT | PAIR).items()])
    m = {n: F.col(n) for n in DIRECT | PAIR}
    return rows.withColumns({"safety": G.safety_reasons(m, F.col("tinted")), "skin": G.skin_reasons(m), "cap": G.cap_reasons(m), "hard": G.fit_reasons(m), "structure": G.structure_reasons(m)})


@query(f"WITH {_T} SELECT l_orderkey, l_linenumber, {_DIRECT_TIER} AS direct_tier, {_FIT_TIER} AS fit_tier FROM t")
def tier_assignment(spark, sf_dir):
    m = {n: F.col(n) for n in DIRECT | PAIR}
    return _measured(spark, sf_dir).select("l_orderkey", "l_linenumber", G.direct_tier(F.col("safety"), F.col("skin"), F.col("cap")).alias("direct_tier"), G.fit_tier(F.col("hard"), F.col("structure"), m, F.col("skin"), F.col("cap")).alias("fit_tier"))


@query(f"WITH {_T} SELECT reason, count(*) AS n FROM (SELECT unnest(list_concat(safety, skin, cap, hard, structure)) AS reason FROM t) GROUP BY reason")
def reject_reason_counts(spark, sf_dir):
    return _measured(spark, sf_dir).select(F.explode(F.concat("safety", "skin", "cap", "hard", "structure")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_T}, g AS (SELECT {_DIRECT_TIER} AS tier, tile, support FROM t) SELECT count(*) AS candidates, count(*) FILTER (tile > 0.5) AS derived, count(*) FILTER (tile > 0.5 AND support >= 0.976) AS canonicalized,
    count(*) FILTER (tier = 'gold') AS gold, count(*) FILTER (tier = 'diagnostic_only') AS diagnostic, count(*) FILTER (tier = 'rejected') AS rejected FROM g"""
)
def attrition_funnel(spark, sf_dir):
    """The funnel's stages as counts of one pass."""
    rows = _measured(spark, sf_dir).withColumn("tier", G.direct_tier(F.col("safety"), F.col("skin"), F.col("cap")))
    count = lambda e: F.count_if(F.expr(e))
    return rows.agg(
        F.count("*").alias("candidates"), count("tile > 0.5").alias("derived"), count("tile > 0.5 AND support >= 0.976").alias("canonicalized"),
        count("tier = 'gold'").alias("gold"), count("tier = 'diagnostic_only'").alias("diagnostic"), count("tier = 'rejected'").alias("rejected"),
    )


@query(
    f"""WITH {_T}, s AS (SELECT l_orderkey, l_linenumber, {sql_split('l_orderkey::VARCHAR')} AS split, {_FIT_TIER} AS tier, mean, l_linenumber % 3 <> 0 AS supported, l_orderkey % 19 = 0 AS filler FROM t),
    e AS (SELECT *, NOT filler AND (tier = 'gold' OR (tier = 'diagnostic_only' AND mean <= 2.5)) AS headline FROM s WHERE split <> 'train')
    SELECT l_orderkey, l_linenumber, CASE WHEN split = 'qualitative' THEN 'qualitative' WHEN split = 'diagnostic' OR NOT headline THEN 'diagnostic' WHEN supported THEN 'usage_weighted_headline_supported' ELSE 'usage_weighted_headline_unsupported' END AS slice FROM e"""
)
def eval_slices(spark, sf_dir):
    m = {n: F.col(n) for n in DIRECT | PAIR}
    rows = _measured(spark, sf_dir).withColumn("tier", G.fit_tier(F.col("hard"), F.col("structure"), m, F.col("skin"), F.col("cap"))).withColumn("split", split_of(F.col("l_orderkey").cast("string")))
    slice_ = G.eval_slice(F.col("split"), F.col("tier"), F.col("mean"), F.col("l_linenumber") % 3 != 0, F.col("l_orderkey") % 19 == 0)
    return rows.select("l_orderkey", "l_linenumber", slice_.alias("slice")).where("slice IS NOT NULL")


@query("SELECT l_shipmode_like AS grp, round(avg(q), 6) AS mean, round(quantile_cont(q, 0.5), 6) AS median, round(quantile_cont(q, 0.95), 6) AS p95, round(quantile_cont(q, 0.99), 6) AS p99, max(q) AS max FROM (SELECT l_returnflag AS l_shipmode_like, l_quantity AS q FROM lineitem) GROUP BY 1")
def percentile_stats(spark, sf_dir):
    """Mean, exact interpolated percentiles and maximum per group."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.avg("l_quantity").alias("mean"), F.expr("percentile(l_quantity, array(0.5, 0.95, 0.99))").alias("q"), F.max("l_quantity").alias("max"))
    return rows.select("grp", F.round("mean", 6).alias("mean"), *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("median", "p95", "p99"))], "max")


#: a part's codes: sixteen numbers from its key
_CODES_DUCK = "list_transform(range(16), lambda i: (p_partkey * 37 + i * p_size * 5) % 256)"
_CODES = "transform(sequence(0, 15), i -> (p_partkey * 37 + i * p_size * 5) % 256)"


@query(
    f"""WITH c AS (SELECT unnest({_CODES_DUCK}) AS code FROM part), h AS (SELECT code, count(*) AS n FROM c GROUP BY code), p AS (SELECT n / sum(n) OVER ()::DOUBLE AS p FROM h)
    SELECT count(*) AS active, round(count(*) / 256.0, 6) AS active_frac, round(exp(-sum(p * ln(p))), 4) AS perplexity, round(max(p), 6) AS top_share, 256 - count(*) AS dead FROM p"""
)
def codebook_usage(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select(F.explode(F.expr(_CODES)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    # ln N - sum(n ln n) / N is the entropy, so no second pass over the shares is needed
    sums = codes.agg(F.count("*").alias("active"), F.sum("n").alias("all"), F.sum(F.col("n") * F.ln("n")).alias("nln"), F.max("n").alias("top"))
    return sums.select("active", F.round(F.col("active") / 256.0, 6).alias("active_frac"), F.round(F.exp(F.ln("all") - F.col("nln") / F.col("all")), 4).alias("perplexity"), F.round(F.col("top") / F.col("all"), 6).alias("top_share"), (256 - F.col("active")).alias("dead"))


@query(
    f"""WITH c AS (SELECT p_partkey, unnest({_CODES_DUCK}) AS code FROM part), h AS (SELECT p_partkey, code, count(*) AS n FROM c GROUP BY ALL)
    SELECT p_partkey, round(-sum(n / 16.0 * log2(n / 16.0)), 6) AS entropy_bits, round(-sum(n / 16.0 * log2(n / 16.0)) / 4, 6) AS normalized, arg_max(code, (n, -code))::INTEGER AS dominant, max(n) / 16.0::DOUBLE AS dominant_share FROM h GROUP BY p_partkey"""
)
def code_entropy(spark, sf_dir):
    """Entropy of a row's codes and its dominant code (ties: the smaller); counted within the row, without a shuffle."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CODES).alias("codes"))
    counts = F.expr("transform(array_distinct(codes), c -> struct(size(filter(codes, x -> x = c)) AS n, -c AS less))")
    rows = rows.withColumn("h", counts)
    bits = F.expr("aggregate(h, 0D, (s, e) -> s - e.n / 16D * log2(e.n / 16D))")
    top = F.array_max("h")
    return rows.select("p_partkey", F.round(bits, 6).alias("entropy_bits"), F.round(bits / 4, 6).alias("normalized"), (-top["less"]).cast("int").alias("dominant"), (top["n"] / 16.0).alias("dominant_share"))


@query(
    f"""WITH s AS (SELECT p_brand || '/' || (p_size % 5) AS spec, {_CODES_DUCK} AS codes FROM part), e AS (SELECT spec, generate_subscripts(codes, 1) AS pos, unnest(codes) AS code FROM s),
    h AS (SELECT spec, pos, code, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT spec, pos, max(n) AS top, sum(n) AS n FROM h GROUP BY ALL), d AS (SELECT spec, count(*) AS n, count(DISTINCT codes) AS k FROM s GROUP BY spec)
    SELECT (SELECT count(*) FROM d) AS specs, (SELECT sum(n) FILTER (k > 1)::BIGINT FROM d) AS lossy_rows, round(sum(top) / sum(n)::DOUBLE, 6) AS ceiling FROM m"""
)
def seam_injectivity(spark, sf_dir):
    """How far a spec text determines its codes: rows of specs with several sequences, and the best position-wise accuracy."""
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), (F.col("p_size") % 5).cast("string")).alias("spec"), F.expr(_CODES).alias("codes"))
    modal = rows.select("spec", F.posexplode("codes").alias("pos", "code")).groupBy("spec", "pos", "code").agg(F.count("*").alias("n")).groupBy("spec", "pos").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    ceiling = modal.agg(F.round(F.sum("top") / F.sum("n"), 6).alias("ceiling"))
    seqs = rows.groupBy("spec", "codes").agg(F.count("*").alias("n")).groupBy("spec").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return seqs.agg(F.count("*").alias("specs"), F.sum(F.when(F.col("k") > 1, F.col("n"))).alias("lossy_rows")).crossJoin(ceiling)


@query(
    f"""WITH {_M} SELECT l_orderkey, l_linenumber, round(least((3.0 - mean) / 3.0, (7.0 - p95) / 7.0, (10.0 - p99) / 10.0, (support - 0.98) / 0.02), 6) AS slack FROM m QUALIFY row_number() OVER (ORDER BY mean <= 3 AND p95 <= 7 AND p99 <= 10 AND support >= 0.98 DESC,
    least((3.0 - mean) / 3.0, (7.0 - p95) / 7.0, (10.0 - p99) / 10.0, (support - 0.98) / 0.02) DESC, l_orderkey, l_linenumber) = 1"""
)
def best_passer(spark, sf_dir):
    """The row with the largest smallest slack; any that passes all gates comes first."""
    slack = F.expr("least((3.0D - mean) / 3.0D, (7.0D - p95) / 7.0D, (10.0D - p99) / 10.0D, (support - 0.98D) / 0.02D)")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(PAIR[n]).cast("double").alias(n) for n in ("mean", "p95", "p99", "support")])
    rows = rows.withColumn("slack", slack).withColumn("ok", F.expr("mean <= 3 AND p95 <= 7 AND p99 <= 10 AND support >= 0.98D"))
    return rows.orderBy(F.desc("ok"), F.desc("slack"), "l_orderkey", "l_linenumber").limit(1).select("l_orderkey", "l_linenumber", F.round("slack", 6).alias("slack"))


@query("SELECT p_partkey, round(1.0 / count(*) OVER (PARTITION BY p_brand), 9) AS weight FROM part")
def family_weights(spark, sf_dir):
    """Family-balanced sampling weights; counts are few rows, joined back."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return parts.join(parts.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand").select("p_partkey", F.round(1.0 / F.col("n"), 9).alias("weight"))


_WIDE = ("BRASS", "COPPER", "NICKEL", "STEEL", "TIN")


@query(f"SELECT p_partkey, [{', '.join(f'(p_type LIKE {chr(39)}%{w}%{chr(39)})::INTEGER::DOUBLE' for w in _WIDE)}, p_size / 10.0, p_retailprice / 1000.0] AS embedding FROM part")
def tag_embedding(spark, sf_dir):
    """A multi-hot vector of tags followed by scalars; unknown tags are ignored."""
    hot = [F.contains("p_type", F.lit(w)).cast("int").cast("double") for w in _WIDE]
    return table(spark, sf_dir, "part").select("p_partkey", F.array(*hot, F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0).alias("embedding"))


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 19 AS tag, (l_quantity - 25) / 5.0 AS v, l_linenumber % 7 = 0 AS styled FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN styled THEN 'not_evaluated' WHEN tag < 10 THEN CASE WHEN v >= 1.5 THEN 'pass' ELSE 'fail' END ELSE CASE WHEN -v >= 1.5 THEN 'pass' ELSE 'fail' END END AS status FROM t"""
)
def direction_check(spark, sf_dir):
    """Whether the measured change has a tag's sign and size; without a directional tag it isn't evaluated."""
    v = F.expr("(l_quantity - 25) / 5.0D")
    signed = F.when(F.col("l_partkey") % 19 < 10, v).otherwise(-v)
    status = F.when(F.col("l_linenumber") % 7 == 0, "not_evaluated").when(signed >= 1.5, "pass").otherwise("fail")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))
