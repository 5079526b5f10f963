"""Evaluation statistics; documents and labels stand in for decisions, line items and events for scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import stats as S
from ..registry import query
from ..sources.tables import table

#: a labelled document is a decision: toxic ones should be refused; a hash of the id decides what the model did
_U = "(('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INTEGER % 100)"
_DECISIONS = f"""r AS (SELECT doc_id, source, lang, CASE WHEN quality = 0 THEN 'clarify' WHEN toxic = 1 THEN 'refuse' ELSE 'grade' END AS route, toxic = 0 AS is_supported,
  (toxic = 1 AND {_U} < 80) OR (toxic = 0 AND {_U} < 10) AS refused, {_U} % 7 <> 0 AS syntax_pass, n_chars % 5 = 0 AS mixed, CASE WHEN lang = 'en' THEN 'out_of_scope' ELSE 'out_of_gamut' END AS kind, doc_id // 20 AS pair
  FROM documents JOIN labels USING (doc_id))"""


def decisions(spark, sf_dir) -> DataFrame:
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 100
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("u", u)
    return rows.select(
        "doc_id", "source", "lang", F.when(F.col("quality") == 0, "clarify").when(F.col("toxic") == 1, "refuse").otherwise("grade").alias("route"), (F.col("toxic") == 0).alias("is_supported"),
        F.expr("(toxic = 1 AND u < 80) OR (toxic = 0 AND u < 10)").alias("refused"), F.expr("u % 7 <> 0").alias("syntax_pass"), F.expr("n_chars % 5 = 0").alias("mixed"),
        F.when(F.col("lang") == "en", "out_of_scope").otherwise("out_of_gamut").alias("kind"), F.floor(F.col("doc_id") / 20).alias("pair"),
    )


#: name -> (population, passed); every metric is one conditional count pair of a single pass
METRICS = {
    "unsupported_recall": ("route = 'refuse'", "refused"),
    "unsupported_precision": ("route <> 'clarify' AND refused", "NOT is_supported"),
    "false_support_rate": ("route = 'refuse'", "NOT refused AND syntax_pass"),
    "over_refusal_rate": ("route = 'grade'", "refused"),
    "supported_coverage": ("route = 'grade'", "NOT refused"),
    "boundary_accuracy": ("route <> 'clarify'", "refused = (route = 'refuse')"),
    "mixed_unsupported_recall": ("route = 'refuse' AND mixed", "refused"),
    "out_of_scope_recall": ("route = 'refuse' AND kind = 'out_of_scope'", "refused"),
    "out_of_gamut_recall": ("route = 'refuse' AND kind = 'out_of_gamut'", "refused"),
    "clarify_over_refusal_rate": ("route = 'clarify'", "refused"),
    "selective_risk_syntax_only": ("route = 'grade' AND NOT refused", "NOT syntax_pass"),
}


def metric_counts(rows: DataFrame, metrics: dict[str, tuple[str, str]], by: list[str] = []) -> DataFrame:
    """(by, metric, k, n, rate) in one pass over rows."""
    sums = rows.groupBy(*by).agg(*[F.count_if(F.expr(f"({pop}) AND ({ok})")).alias(f"k_{m}") for m, (pop, ok) in metrics.items()], *[F.count_if(F.expr(pop)).alias(f"n_{m}") for m, (pop, _) in metrics.items()])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"k_{m}").alias("k"), F.col(f"n_{m}").alias("n")) for m in metrics])
    return sums.select(*by, F.explode(cells).alias("c")).select(*by, "c.*").withColumn("rate", F.expr("k / nullif(n, 0)"))


def _metrics_sql(by: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {by}'{m}' AS metric, count(*) FILTER (({pop}) AND ({ok})) AS k, count(*) FILTER ({pop}) AS n FROM r" + (f" GROUP BY {by.rstrip(', ')}" if by else "") for m, (pop, ok) in METRICS.items())


@query(f"WITH {_DECISIONS}, m AS ({_metrics_sql()}) SELECT metric, k, n, round(k / nullif(n, 0)::DOUBLE, 6) AS rate FROM m")
def boundary_metrics(spark, sf_dir):
    return metric_counts(decisions(spark, sf_dir), METRICS).withColumn("rate", F.round("rate", 6))


_CONFUSION = "count(*) FILTER (route = 'refuse' AND refused) AS tp, count(*) FILTER (route = 'refuse' AND NOT refused) AS fn, count(*) FILTER (route = 'grade' AND refused) AS fp, count(*) FILTER (route = 'grade' AND NOT refused) AS tn"
_F1_SQL = "CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) WHEN tp + fp + fn > 0 THEN 0.0 END"


def confusion_of(rows: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts of the refusal detector and its precision, recall and F1 (0 without a hit, null without any case)."""
    cells = {"tp": "route = 'refuse' AND refused", "fn": "route = 'refuse' AND NOT refused", "fp": "route = 'grade' AND refused", "tn": "route = 'grade' AND NOT refused"}
    sums = rows.groupBy(*by).agg(*[F.count_if(F.expr(e)).alias(n) for n, e in cells.items()])
    return sums.withColumns({"precision": F.expr("tp / nullif(tp + fp, 0)"), "recall": F.expr("tp / nullif(tp + fn, 0)"), "f1": F.expr("CASE WHEN tp > 0 THEN 2.0D * tp / (2 * tp + fp + fn) WHEN tp + fp + fn > 0 THEN 0.0D END")})


@query(f"WITH {_DECISIONS}, c AS (SELECT {_CONFUSION} FROM r) SELECT tp, fn, fp, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round({_F1_SQL}, 6) AS f1 FROM c")
def confusion(spark, sf_dir):
    return confusion_of(decisions(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    f"""WITH {_DECISIONS}, p AS (SELECT pair, count(*) >= 2 AND bool_or(is_supported) AND bool_or(NOT is_supported) AS complete, bool_and(refused = (NOT is_supported)) AS correct FROM r GROUP BY pair)
    SELECT pair, complete, complete AND correct AS passed FROM p"""
)
def boundary_pairs(spark, sf_dir):
    """A pair passes if it has both polarities and every member is decided rightly."""
    by = decisions(spark, sf_dir).groupBy("pair").agg((F.expr("count(*) >= 2") & F.bool_or("is_supported") & F.bool_or(~F.col("is_supported"))).alias("complete"), F.bool_and(F.expr("refused = (NOT is_supported)")).alias("correct"))
    return by.select("pair", "complete", F.expr("complete AND correct").alias("passed"))


@query(f"WITH {_DECISIONS} SELECT source, count(*) AS n, count(*) FILTER (refused) AS k, round(avg(refused::INTEGER), 6) AS recall FROM r WHERE route = 'refuse' GROUP BY source")
def per_category_recall(spark, sf_dir):
    rows = decisions(spark, sf_dir).where("route = 'refuse'")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("refused").alias("k"), F.round(F.avg(F.col("refused").cast("int")), 6).alias("recall"))


@query(
    f"WITH {_DECISIONS} SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, count(*) AS n, round(avg((refused = (route = 'refuse'))::INTEGER), 6) AS accuracy FROM r WHERE route <> 'clarify' GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))"
)
def grouping_sets_accuracy(spark, sf_dir):
    """Overall, by language, by source and by both, in one pass."""
    rows = decisions(spark, sf_dir).where("route <> 'clarify'").withColumn("ok", F.expr("cast(refused = (route = 'refuse') AS int)"))
    return rows.cube("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy")).select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"), "n", "accuracy")


def _wilson_sql(bound: int) -> str:
    sign, cut = ("-", "greatest(0.0, ") if bound == 0 else ("+", "least(1.0, ")
    z = S.Z
    return f"CASE WHEN n > 0 THEN {cut}((k / n::DOUBLE + {z * z} / (2.0 * n)) {sign} {z} * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + {z * z} / (4.0 * n * n))) / (1 + {z * z} / n)) END"


@query(f"WITH {_DECISIONS}, m AS ({_metrics_sql()}) SELECT metric, k, n, round({_wilson_sql(0)}, 6) AS lower, round({_wilson_sql(1)}, 6) AS upper FROM m")
def wilson_ci(spark, sf_dir):
    rows = metric_counts(decisions(spark, sf_dir), METRICS)
    lower, upper = S.wilson(F.col("k"), F.col("n"))
    return rows.select("metric", "k", "n", F.round(lower, 6).alias("lower"), F.round(upper, 6).alias("upper"))


#: metric, direction, threshold, smallest population
GATES = [("unsupported_recall", "min", 0.70, 30), ("over_refusal_rate", "max", 0.15, 100), ("boundary_accuracy", "min", 0.85, 100), ("mixed_unsupported_recall", "min", 0.60, 50), ("out_of_gamut_recall", "min", 0.60, 10), ("unsupported_recall", "min", 0.99, 1)]


@query(
    f"""WITH {_DECISIONS}, m AS ({_metrics_sql()}), g(metric, direction, threshold, min_n, ord) AS (VALUES {", ".join(f"('{m}', '{d}', {t}, {n}, {i})" for i, (m, d, t, n) in enumerate(GATES))}),
    f AS (SELECT metric, min_by(direction, ord) AS direction, min_by(threshold, ord) AS threshold, min_by(min_n, ord) AS min_n FROM g GROUP BY metric)
    SELECT m.metric, f.direction, f.threshold::DOUBLE AS threshold, n, CASE WHEN n < min_n THEN 'not-evaluable-below-min_N' WHEN (direction = 'min' AND {_wilson_sql(0)} >= threshold) OR (direction = 'max' AND {_wilson_sql(1)} <= threshold) THEN 'pass' ELSE 'fail' END AS verdict
    FROM m JOIN f USING (metric)"""
)
def wilson_gates(spark, sf_dir):
    """Gate verdicts; of two registry entries for a metric the first counts."""
    entries = spark.createDataFrame([(*g, i) for i, g in enumerate(GATES)], "metric string, direction string, threshold double, min_n int, ord int")
    first = entries.groupBy("metric").agg(F.min_by(F.struct("direction", "threshold", "min_n"), "ord").alias("g")).select("metric", "g.*")
    rows = metric_counts(decisions(spark, sf_dir), METRICS).join(F.broadcast(first), "metric")
    lower, upper = S.wilson(F.col("k"), F.col("n"))
    return rows.select("metric", "direction", "threshold", "n", S.gate(lower, upper, F.col("n"), F.col("min_n"), F.col("threshold"), F.col("direction")).alias("verdict"))


_PAIRED = f"p AS (SELECT lang, doc_id, source, {_U} < 80 AS x, {_U} % 10 < 7 AS y FROM documents JOIN labels USING (doc_id))"


def _paired(spark, sf_dir) -> DataFrame:
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 100
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return rows.select("doc_id", "lang", "source", (u < 80).alias("x"), (u % 10 < 7).alias("y"))


_CHOOSE = "(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1))"
_MCNEMAR = f"""{_PAIRED}, t AS (SELECT lang, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (y AND NOT x) AS c FROM p GROUP BY lang),
q AS (SELECT lang, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp({_CHOOSE} - (b + c) * ln(2))))) END AS p FROM t)"""


@query(f"WITH {_MCNEMAR} SELECT lang, b, c, round(p, 6) AS p, round(CASE WHEN b + c = 0 THEN 0.0 ELSE greatest(abs(b - c) - 1, 0)::DOUBLE ** 2 / (b + c) END, 6) AS statistic FROM q")
def mcnemar(spark, sf_dir):
    rows = _paired(spark, sf_dir).groupBy("lang").agg(F.count_if(F.expr("x AND NOT y")).alias("b"), F.count_if(F.expr("y AND NOT x")).alias("c"))
    p, stat = S.mcnemar(F.col("b"), F.col("c"))
    return rows.select("lang", "b", "c", F.round(p, 6).alias("p"), F.round(stat, 6).alias("statistic"))


@query(
    f"""WITH {_MCNEMAR}, k AS (SELECT lang, p, row_number() OVER (ORDER BY p, lang) AS rank, count(*) OVER () AS m FROM q), h AS (SELECT *, 0.05 / (m - rank + 1) AS threshold FROM k)
    SELECT lang, rank::INTEGER AS rank, round(threshold::DOUBLE, 6) AS threshold, bool_and(p <= threshold) OVER (ORDER BY p, lang) AS rejected FROM h"""
)
def holm(spark, sf_dir):
    rows = _paired(spark, sf_dir).groupBy("lang").agg(F.count_if(F.expr("x AND NOT y")).alias("b"), F.count_if(F.expr("y AND NOT x")).alias("c"))
    tested = S.holm(rows.select("lang", S.mcnemar(F.col("b"), F.col("c"))[0].alias("p")), name="lang")
    return tested.select("lang", "rank", F.round("threshold", 6).alias("threshold"), "rejected")


@query(
    """SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS mean, round(coalesce(stddev_samp(l_discount), 0), 6) AS std, min(l_discount) AS low, round(quantile_cont(l_discount, 0.5), 6) AS median, max(l_discount) AS high,
    round(avg(l_discount) - 1.9600 * coalesce(stddev_samp(l_discount), 0) / sqrt(count(*)), 4) AS ci_low FROM lineitem GROUP BY l_returnflag"""
)
def seed_summary(spark, sf_dir):
    """Mean, sample deviation and interval per group; the quantile is Student's, here at its large-sample value."""
    std = F.coalesce(F.stddev_samp("l_discount"), F.lit(0.0))
    t = round(S.t_quantile(0.975, 10_000_000), 4)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(std, 6).alias("std"), F.min("l_discount").alias("low"), F.round(F.expr("percentile(l_discount, 0.5)"), 6).alias("median"),
        F.max("l_discount").alias("high"), F.round(F.avg("l_discount") - t * std / F.sqrt(F.count("*")), 4).alias("ci_low"),
    )


def _poisson_sql(u: str) -> str:
    import math

    out, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        out.append(f"WHEN {u} < {total!r} THEN {k}")
        term /= k + 1
    return f"CASE {' '.join(out)} ELSE 8 END"


def _draw_sql(seed: int, *parts: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {" || ':' || ".join(parts)}), 1, 8))::BIGINT / {float(1 << 32)})"


#: replicates of the intervals to report
PAIRED_REPLICATES, CLUSTER_REPLICATES = 10_000, 2_000


@query(
    f"""WITH {_PAIRED}, d AS (SELECT doc_id, lang, x::INTEGER - y::INTEGER AS delta, 1 AS one FROM p), w AS (SELECT lang, r, delta, {_poisson_sql(_draw_sql(5, 'r', 'doc_id'))} AS w FROM d, range(200) t(r)),
    e AS (SELECT lang, r, sum(w * delta) / nullif(sum(w), 0)::DOUBLE AS x FROM w GROUP BY ALL), q AS (SELECT lang, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM e GROUP BY lang)
    SELECT lang, round(avg(delta), 6) AS estimate, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM d JOIN q USING (lang) GROUP BY lang"""
)
def paired_bootstrap(spark, sf_dir, replicates: int = 200):
    """Mean difference of paired outcomes with its interval, per stratum; with few replicates, for the SQL to follow."""
    rows = _paired(spark, sf_dir).select("doc_id", "lang", F.expr("cast(x AS int) - cast(y AS int)").alias("delta"), F.lit(1).alias("one"))
    return S.bootstrap_ratio(rows, "delta", "one", "doc_id", replicates, 5, ["lang"]).select("lang", *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])


@query()
def paired_bootstrap_whole(spark, sf_dir):
    """paired_bootstrap with the number of replicates to report."""
    return paired_bootstrap(spark, sf_dir, PAIRED_REPLICATES)


@query(
    f"""WITH u AS (SELECT l_suppkey AS unit, count(*) FILTER (l_returnflag = 'R') AS c, count(*) AS t FROM lineitem GROUP BY l_suppkey), w AS (SELECT r, c, t, {_poisson_sql(_draw_sql(9, 'r', 'unit'))} AS w FROM u, range(400) x(r)),
    e AS (SELECT r, sum(w * c) / nullif(sum(w * t), 0)::DOUBLE AS x FROM w GROUP BY r)
    SELECT (SELECT round(sum(c) / sum(t)::DOUBLE, 6) FROM u) AS estimate, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM e"""
)
def cluster_bootstrap(spark, sf_dir, replicates: int = 400):
    """A ratio over rows with an interval that resamples whole units; with few replicates, for the SQL to follow."""
    unit = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.count_if(F.expr("l_returnflag = 'R'")).alias("c"), F.count("*").alias("t"))
    return S.bootstrap_ratio(unit, "c", "t", "unit", replicates, 9).select(*[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])


@query()
def cluster_bootstrap_whole(spark, sf_dir):
    """cluster_bootstrap with the number of replicates to report."""
    return cluster_bootstrap(spark, sf_dir, CLUSTER_REPLICATES)


@query(f"WITH {_PAIRED} SELECT x, y, count(*) AS n FROM p GROUP BY CUBE (x, y)")
def agreement_matrix(spark, sf_dir):
    """Cells of two verdicts with their margins."""
    return _paired(spark, sf_dir).cube("x", "y").agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRED} SELECT coalesce(lang, '_overall') AS defect, count(*) AS n, count(*) FILTER (x) AS by_det, count(*) FILTER (y) AS by_judge, count(*) FILTER (x OR y) AS caught FROM p GROUP BY ROLLUP (lang)")
def catch_rate(spark, sf_dir):
    rows = _paired(spark, sf_dir).rollup("lang").agg(F.count("*").alias("n"), F.count_if("x").alias("by_det"), F.count_if("y").alias("by_judge"), F.count_if(F.expr("x OR y")).alias("caught"))
    return rows.select(F.coalesce("lang", F.lit("_overall")).alias("defect"), "n", "by_det", "by_judge", "caught")


@query(
    """WITH f AS (SELECT l_suppkey AS family, avg(l_discount) AS f FROM lineitem GROUP BY 1) SELECT round((SELECT avg(l_discount) FROM lineitem), 4) AS micro, round(avg(f), 4) AS macro, count(*) AS families FROM f"""
)
def micro_macro(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_discount").alias("s"), F.count("*").alias("n"))
    return by.agg(F.round(F.sum("s") / F.sum("n"), 4).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 4).alias("macro"), F.count("*").alias("families"))


_ROLLOUTS = "s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS sample, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 100 END AS fidelity, event_id % 4 = 0 AS collapsed, value, event_id FROM events)"


def _rollouts(spark, sf_dir) -> DataFrame:
    """Events of a user and type are the samples of one prompt, in time order."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_type", (F.row_number().over(order) - 1).alias("sample"), F.when(F.col("event_id") % 9 != 0, F.col("value") / 100).alias("fidelity"), (F.col("event_id") % 4 == 0).alias("collapsed"), "value", "event_id"
    )


@query(f"WITH {_ROLLOUTS} SELECT event_id, round((fidelity - avg(fidelity) OVER g) / (coalesce(stddev_pop(fidelity) OVER g, 0) + 1e-4), 4) AS advantage FROM s WINDOW g AS (PARTITION BY user_id, event_type)")
def group_advantage(spark, sf_dir):
    """Rewards standardised within their prompt; null rewards stay null."""
    group = Window.partitionBy("user_id", "event_type")
    spread = F.coalesce(F.stddev_pop("fidelity").over(group), F.lit(0.0)) + 1e-4
    return _rollouts(spark, sf_dir).select("event_id", F.round((F.col("fidelity") - F.avg("fidelity").over(group)) / spread, 4).alias("advantage"))


_KS = (1, 4, 8, 16, 32, 64)


@query(
    f"WITH {_ROLLOUTS}, b AS (SELECT user_id, event_type, k, max(fidelity) AS best FROM s JOIN (VALUES {', '.join(f'({k})' for k in _KS)}) v(k) ON sample < k GROUP BY ALL) SELECT k::INTEGER AS k, count(best) AS prompts, round(avg(best), 6) AS oracle FROM b GROUP BY k"
)
def oracle_at_k(spark, sf_dir):
    """Mean over prompts of the best of the first k samples; prompts without a scored sample drop out."""
    by = _rollouts(spark, sf_dir).groupBy("user_id", "event_type").agg(*[F.max(F.when(F.col("sample") < k, F.col("fidelity"))).alias(f"k{k}") for k in _KS])
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("best")) for k in _KS])
    return by.select(F.explode(cells).alias("c")).groupBy("c.k").agg(F.count("c.best").alias("prompts"), F.round(F.avg("c.best"), 6).alias("oracle"))


@query(f"WITH {_ROLLOUTS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(fidelity, 0) DESC, collapsed, value, sample) AS r FROM s) SELECT user_id, event_type, sample::INTEGER AS sample, event_id FROM k WHERE r = 1")
def best_of_n(spark, sf_dir):
    """Each prompt's best sample: fidelity (null as 0), not collapsed, smaller error, earlier."""
    rank = F.struct(F.coalesce("fidelity", F.lit(0.0)), ~F.col("collapsed"), -F.col("value"), -F.col("sample"))
    return _rollouts(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by(F.struct("sample", "event_id"), rank).alias("b")).select("user_id", "event_type", "b.sample", "b.event_id")


@query(f"WITH {_ROLLOUTS} SELECT event_id, round(max(fidelity) OVER (PARTITION BY user_id, event_type ORDER BY sample), 6) AS best FROM s")
def running_best(spark, sf_dir):
    so_far = Window.partitionBy("user_id", "event_type").orderBy("sample").rowsBetween(Window.unboundedPreceding, 0)
    return _rollouts(spark, sf_dir).select("event_id", F.round(F.max("fidelity").over(so_far), 6).alias("best"))


@query(f"WITH {_ROLLOUTS} SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN fidelity IS NULL THEN NULL ELSE round(greatest(0, fidelity - CASE WHEN collapsed THEN 0.25 ELSE 0 END), 6) END::DOUBLE AS reward FROM s")
def shaped_reward(spark, sf_dir):
    """Refusals earn 0, samples without axes nothing, collapsed ones a quarter less."""
    reward = F.greatest(F.lit(0.0), F.col("fidelity") - F.when(F.col("collapsed"), 0.25).otherwise(0.0))
    return _rollouts(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 11 == 0, 0.0).when(F.col("fidelity").isNotNull(), F.round(reward, 6)).alias("reward"))
