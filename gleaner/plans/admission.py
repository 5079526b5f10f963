"""Gates that decide what is admitted: reconstruction, collapse, distillation, tags against behaviour, domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as S
from ..registry import query
from ..sources.tables import table
from .evaluation import _DECISIONS, _wilson_sql, decisions
from .measures import _CODES, _CODES_DUCK

# Limits of the reconstruction gate, per family, and of admission; the codebook's are alerts.
GATE = {"mean_deltae": 2.0, "p95_deltae": 4.0, "p99_deltae": 6.0, "max_deltae": 10.0, "mean_psnr": 35.0, "p5_psnr": 30.0}
FAMILY = {"mean_deltae": 2.5, "p95_deltae": 5.0}
FAMILY_ROWS = 30
ACTIVE_FRACTION, PERPLEXITY = 0.70, 64.0
ADMISSION = {"mean": 3.0, "p95": 6.0}
# Residual norms under which a table does nothing, and a code's share from which it dominates.
DEGENERATE, COLLAPSED, DOMINANT = 5e-4, 0.01, 0.5
# The smallest move that backs a tag, the one that must be mentioned, and the axes that may need it.
BACKED, MAJOR = 1.0, 2.0
MAJOR_AXES = ("temperature_delta_b", "tint_delta_a", "mean_l_delta", "chroma_delta", "contrast_l_spread_delta")
# Declared domains.
REJECTED_DOMAINS = ("camera_log", "log", "acescg", "linear_unknown", "unknown_camera_log")
ADOBE_DOMAINS = ("adobe_rgb", "adobergb", "adobe_rgb_1998", "argb")
SRGB_DOMAINS = ("srgb", "srgb_display", "srgb_8bit", "srgb_encoded", "rec709_srgb")

_RECON = "r AS (SELECT l_linestatus || (l_suppkey % 40) AS family, l_quantity / 12.0 AS de, 25 + 250 * l_discount AS psnr FROM lineitem)"


def recon(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", (F.col("l_suppkey") % 40).cast("string")).alias("family"), (F.col("l_quantity") / 12.0).alias("de"), (25 + 250 * F.col("l_discount")).alias("psnr"))


@query(
    f"""WITH {_RECON}, a AS (SELECT avg(de) AS mean, quantile_cont(de, [0.95, 0.99]) AS q, max(de) AS top, avg(psnr) AS psnr, quantile_cont(psnr, 0.05) AS low, bool_and(isfinite(de) AND isfinite(psnr)) AS finite FROM r),
    f AS (SELECT family, count(*) AS n, avg(de) AS mean, quantile_cont(de, 0.95) AS p95 FROM r GROUP BY family), c AS (SELECT unnest({_CODES_DUCK}) AS code FROM part), h AS (SELECT code, count(*) AS n FROM c GROUP BY code),
    u AS (SELECT count(*) / 256.0 AS active, exp(ln(sum(n)) - sum(n * ln(n)) / sum(n)) AS perplexity FROM h),
    k AS (SELECT 'mean_deltae' AS name, 'check' AS kind, mean AS value, mean <= 2.0 AS passed FROM a UNION ALL SELECT 'p95_deltae', 'check', q[1], q[1] <= 4.0 FROM a UNION ALL SELECT 'p99_deltae', 'check', q[2], q[2] <= 6.0 FROM a
      UNION ALL SELECT 'max_deltae', 'check', top, top <= 10.0 FROM a UNION ALL SELECT 'mean_psnr', 'check', psnr, psnr >= 35.0 FROM a UNION ALL SELECT 'p5_psnr', 'check', low, low >= 30.0 FROM a UNION ALL SELECT 'finite', 'check', finite::INTEGER, finite FROM a
      UNION ALL SELECT 'family[' || family || '].mean_deltae', 'check', mean, mean <= 2.5 FROM f WHERE n >= 30 UNION ALL SELECT 'family[' || family || '].p95_deltae', 'check', p95, p95 <= 5.0 FROM f WHERE n >= 30
      UNION ALL SELECT 'family[' || family || '] too few', 'alert', n, NULL FROM f WHERE n < 30 UNION ALL SELECT 'active_codes', 'alert', active, NULL FROM u WHERE active < 0.7 UNION ALL SELECT 'perplexity', 'alert', perplexity, NULL FROM u WHERE perplexity < 64)
    SELECT name, kind, round(value::DOUBLE, 6) AS value, passed FROM k UNION ALL SELECT 'gate', 'verdict', NULL, bool_and(passed) FROM k WHERE kind = 'check'"""
)
def tokenizer_gate(spark, sf_dir):
    """Hard checks over all rows and over families with enough rows, alerts of small families and of the codebook, the verdict.

    Families are groups, not rows, and all checks come from two aggregations of the rows.
    """
    rows = recon(spark, sf_dir)
    over = rows.agg(
        F.avg("de").alias("mean_deltae"), F.percentile("de", F.lit(0.95)).alias("p95_deltae"), F.percentile("de", F.lit(0.99)).alias("p99_deltae"), F.max("de").alias("max_deltae"), F.avg("psnr").alias("mean_psnr"), F.percentile("psnr", F.lit(0.05)).alias("p5_psnr"),
        F.bool_and(F.expr("NOT isnan(de) AND abs(de) < double('Infinity') AND NOT isnan(psnr) AND abs(psnr) < double('Infinity')")).alias("finite"),
    )
    line = lambda name, kind, value, passed: F.struct(name.alias("name"), F.lit(kind).alias("kind"), value.cast("double").alias("value"), passed.cast("boolean").alias("passed"))
    within = lambda m, limit: F.col(m) >= limit if "psnr" in m else F.col(m) <= limit
    none = F.lit(None)
    whole = over.select(F.explode(F.array(*[line(F.lit(m), "check", F.col(m), within(m, x)) for m, x in GATE.items()], line(F.lit("finite"), "check", F.col("finite").cast("int"), F.col("finite")))).alias("c"))
    families = rows.groupBy("family").agg(F.count("*").alias("n"), F.avg("de").alias("mean_deltae"), F.percentile("de", F.lit(0.95)).alias("p95_deltae"))
    named = lambda m: F.concat(F.lit("family["), F.col("family"), F.lit(f"]{m}"))
    each = families.select(F.explode(F.when(F.col("n") >= FAMILY_ROWS, F.array(*[line(named("." + m), "check", F.col(m), F.col(m) <= x) for m, x in FAMILY.items()])).otherwise(F.array(line(named(" too few"), "alert", F.col("n"), none)))).alias("c"))
    codes = table(spark, sf_dir, "part").select(F.explode(F.expr(_CODES)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    health = codes.agg((F.count("*") / 256.0).alias("active"), F.exp(F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("perplexity"))
    alerts = health.select(F.explode(F.array_compact(F.array(F.when(F.col("active") < ACTIVE_FRACTION, line(F.lit("active_codes"), "alert", F.col("active"), none)), F.when(F.col("perplexity") < PERPLEXITY, line(F.lit("perplexity"), "alert", F.col("perplexity"), none))))).alias("c"))
    checks = whole.unionByName(each).unionByName(alerts).select("c.name", "c.kind", F.round("c.value", 6).alias("value"), "c.passed")
    verdict = checks.where("kind = 'check'").agg(F.bool_and("passed").alias("passed")).select(F.lit("gate").alias("name"), F.lit("verdict").alias("kind"), F.lit(None).cast("double").alias("value"), "passed")
    return checks.unionByName(verdict)


@query(
    f"""WITH {_RECON}, b AS (SELECT count(*) FILTER (len({_CODES_DUCK}) <> 16 OR len(list_filter({_CODES_DUCK}, lambda c: c < 0 OR c > 255)) > 0) AS bad FROM part), a AS (SELECT avg(de) AS mean, quantile_cont(de, 0.95) AS p95 FROM r)
    SELECT round(mean, 6) AS mean, round(p95, 6) AS p95, bad, CASE WHEN bad > 0 THEN 'abort_tokens' WHEN mean <= 3.0 AND p95 <= 6.0 THEN 'write' ELSE 'abort_gate' END AS verdict FROM a, b"""
)
def admission_gate(spark, sf_dir):
    """Whether materialised tokens may be written: all ids valid, and errors within the admission limits."""
    wrong = F.expr(f"size({_CODES}) <> 16 OR exists({_CODES}, c -> c < 0 OR c > 255)")
    bad = table(spark, sf_dir, "part").agg(F.count_if(wrong).alias("bad"))
    errors = recon(spark, sf_dir).agg(F.avg("de").alias("mean"), F.percentile("de", F.lit(0.95)).alias("p95"))
    verdict = F.when(F.col("bad") > 0, "abort_tokens").when((F.col("mean") <= ADMISSION["mean"]) & (F.col("p95") <= ADMISSION["p95"]), "write").otherwise("abort_gate")
    return errors.crossJoin(bad).select(F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"), "bad", verdict.alias("verdict"))


_SCORED = f"""s AS (SELECT p_partkey, (p_partkey % 97) / 2000.0 AS rms, {_CODES_DUCK} AS codes, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_partkey % 11) / 10.0 END AS fidelity, p_size / 10.0 AS de FROM part),
h AS (SELECT p_partkey, code, count(*) AS n FROM (SELECT p_partkey, unnest(codes) AS code FROM s) GROUP BY ALL), d AS (SELECT p_partkey, max(n) / 16.0 AS share, -sum(n / 16.0 * log2(n / 16.0)) / 8 AS entropy FROM h GROUP BY p_partkey),
c AS (SELECT p_partkey, rms, fidelity, de, share, entropy, rms < 0.0005 AS degenerate, rms < 0.01 OR share >= 0.5 AS collapsed FROM s JOIN d USING (p_partkey))"""


def scored(spark, sf_dir) -> DataFrame:
    """Scored rows with what their codes show, counted within the row."""
    rows = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 97) / 2000.0).alias("rms"), F.expr(_CODES).alias("codes"), F.when(F.col("p_size") % 5 != 0, (F.col("p_partkey") % 11) / 10.0).alias("fidelity"), (F.col("p_size") / 10.0).alias("de"))
    shares = F.expr("transform(array_distinct(codes), c -> size(filter(codes, x -> x = c)) / 16D)")
    rows = rows.withColumn("shares", shares).withColumns({"share": F.array_max("shares"), "entropy": F.expr("aggregate(shares, 0D, (s, p) -> s - p * log2(p)) / 8")})
    return rows.withColumns({"degenerate": F.col("rms") < DEGENERATE, "collapsed": (F.col("rms") < COLLAPSED) | (F.col("share") >= DOMINANT)})


@query(f"WITH {_SCORED} SELECT p_partkey, degenerate, collapsed, share::DOUBLE AS dominant_share FROM c")
def collapse_flags(spark, sf_dir):
    """A result collapsed if it does next to nothing or one code makes up half of it."""
    return scored(spark, sf_dir).select("p_partkey", "degenerate", "collapsed", F.col("share").alias("dominant_share"))


@query(
    f"""WITH {_SCORED} SELECT count(*) AS "rows", count(fidelity) AS grade_rows, round(avg(fidelity), 6) AS fidelity_mean, round(avg(collapsed::INTEGER), 6) AS collapse_rate, round(avg(degenerate::INTEGER), 6) AS degenerate_rate, round(avg(rms), 6) AS residual_mean,
    round(median(rms), 6) AS residual_median, round(avg(de), 6) AS delta_e_mean, round(avg(entropy), 6) AS entropy_mean, round(avg(share), 6) AS dominant_mean FROM c"""
)
def fidelity_summary(spark, sf_dir):
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return scored(spark, sf_dir).agg(
        F.count("*").alias("rows"), F.count("fidelity").alias("grade_rows"), F.round(F.avg("fidelity"), 6).alias("fidelity_mean"), rate("collapsed").alias("collapse_rate"), rate("degenerate").alias("degenerate_rate"), F.round(F.avg("rms"), 6).alias("residual_mean"),
        F.round(F.median("rms"), 6).alias("residual_median"), F.round(F.avg("de"), 6).alias("delta_e_mean"), F.round(F.avg("entropy"), 6).alias("entropy_mean"), F.round(F.avg("share"), 6).alias("dominant_mean"),
    )


@query(
    f"""WITH {_SCORED} SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 AND coalesce(fidelity, 0) >= 0.6 THEN 'distilled' ELSE 'gold' END AS status FROM c"""
)
def distill_replace(spark, sf_dir):
    """A row's target is replaced only by a whole winner (some have lost codes) that clears the absolute bar; no fidelity counts as 0."""
    rows = scored(spark, sf_dir).withColumn("best", F.when(F.col("p_partkey") % 13 == 0, F.slice("codes", 1, 9)).otherwise(F.col("codes")))
    return rows.select("p_partkey", F.when((F.size("best") == 16) & (F.coalesce("fidelity", F.lit(0.0)) >= 0.6), "distilled").otherwise("gold").alias("status"))


@query(
    """WITH r AS (SELECT o_custkey AS unit, o_orderkey % 3 = 0 AS base, o_orderkey % 5 < 2 AS oracle FROM orders), a AS (SELECT avg(base::INTEGER) AS b, avg(oracle::INTEGER) AS o, count(*) AS n, count(DISTINCT unit) AS units FROM r)
    SELECT CASE WHEN o >= b THEN 'PASS' ELSE 'FAIL' END AS recommendation, round(b, 6) AS baseline, round(o, 6) AS oracle, round(o - b, 6) AS delta, n AS scored_rows, units AS scored_units FROM a"""
)
def oracle_gate(spark, sf_dir):
    """Whether the true spec conditions at least as well as the free text."""
    rows = table(spark, sf_dir, "orders").agg(F.avg((F.col("o_orderkey") % 3 == 0).cast("int")).alias("b"), F.avg((F.col("o_orderkey") % 5 < 2).cast("int")).alias("o"), F.count("*").alias("n"), F.countDistinct("o_custkey").alias("units"))
    return rows.select(F.when(F.col("o") >= F.col("b"), "PASS").otherwise("FAIL").alias("recommendation"), F.round("b", 6).alias("baseline"), F.round("o", 6).alias("oracle"), F.round(F.col("o") - F.col("b"), 6).alias("delta"), F.col("n").alias("scored_rows"), F.col("units").alias("scored_units"))


@query("WITH r AS (SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT CASE WHEN n = 0 THEN 'skipped' WHEN n <> 4 THEN 'partial' ELSE 'scored' END AS outcome, count(*) AS n FROM r GROUP BY ALL")
def exact_guard(spark, sf_dir):
    """Rows without a position are skipped, those with another number than four are partial and not scored."""
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(held, "o_orderkey", "left")
    return rows.groupBy(F.when(F.col("n").isNull(), "skipped").when(F.col("n") != 4, "partial").otherwise("scored").alias("outcome")).agg(F.count("*").alias("n"))


_SEEN_DOMAINS = ["sRGB", "rec709_srgb", "ADOBE_RGB", "camera_log", "wide", None, "argb", "ACEScg"]
_LIST = "[" + ", ".join("NULL" if d is None else f"'{d}'" for d in _SEEN_DOMAINS) + "]"


@query(
    f"""WITH p AS (SELECT p_partkey, lower(({_LIST})[p_partkey % 8 + 1]) AS dom, p_retailprice / 1000 - 0.5 AS low, p_retailprice / 1500 AS high, p_size FROM part)
    SELECT p_partkey, CASE WHEN dom IN {REJECTED_DOMAINS} THEN 'camera_log_unknown_domain:' || dom END AS reject_reason,
    CASE WHEN dom IN {REJECTED_DOMAINS} THEN 'reject_domain:' || dom ELSE concat_ws('|', CASE WHEN dom NOT IN {ADOBE_DOMAINS + SRGB_DOMAINS} THEN 'assumed_srgb:' || dom END, CASE WHEN low < 0 OR high > 1 THEN 'clipped_out_of_range' END,
      CASE WHEN dom IN {ADOBE_DOMAINS} THEN 'color_managed_adobe_rgb_to_srgb' WHEN p_size <> 17 THEN 'resampled_' || p_size || '_to_17' END) END AS warnings FROM p"""
)
def canonical_domains(spark, sf_dir):
    """What becomes of a table by its declared domain, range and grid: rejected, or accepted with warnings."""
    dom = F.lower(F.element_at(F.array(*[F.lit(d) for d in _SEEN_DOMAINS]), (F.col("p_partkey") % 8 + 1).cast("int")))
    rows = table(spark, sf_dir, "part").select("p_partkey", dom.alias("dom"), (F.col("p_retailprice") / 1000 - 0.5).alias("low"), (F.col("p_retailprice") / 1500).alias("high"), "p_size")
    gone, adobe = F.coalesce(F.col("dom").isin(*REJECTED_DOMAINS), F.lit(False)), F.coalesce(F.col("dom").isin(*ADOBE_DOMAINS), F.lit(False))
    known = F.coalesce(F.col("dom").isin(*SRGB_DOMAINS), F.lit(True)) | adobe
    notes = F.concat_ws(
        "|", F.when(~known, F.concat(F.lit("assumed_srgb:"), F.col("dom"))), F.when((F.col("low") < 0) | (F.col("high") > 1), "clipped_out_of_range"),
        F.when(adobe, "color_managed_adobe_rgb_to_srgb").when(F.col("p_size") != 17, F.concat(F.lit("resampled_"), F.col("p_size").cast("string"), F.lit("_to_17"))),
    )
    return rows.select("p_partkey", F.when(gone, F.concat(F.lit("camera_log_unknown_domain:"), F.col("dom"))).alias("reject_reason"), F.when(gone, F.concat(F.lit("reject_domain:"), F.col("dom"))).otherwise(notes).alias("warnings"))


_TAGS = list(T.TAG_AXIS)
_AXES = sorted({a for a, _ in T.TAG_AXIS.values()})
#: each part's measured move on every axis, and its two tags with a style now and then
_MOVE = {a: f"(((p_partkey * {7 + 2 * i} + p_size * {3 + i}) % 81) - 40) / 10.0" for i, a in enumerate(_AXES)}
_TAGGED = f"""b AS (SELECT p_partkey, ({_TAGS})[(p_partkey % {len(_TAGS)})::INTEGER + 1] AS one, ({_TAGS})[(p_size % {len(_TAGS)})::INTEGER + 1] AS two, p_partkey % 7 = 0 AS styled, {", ".join(f"{e} AS {a}" for a, e in _MOVE.items())} FROM part),
m AS (UNPIVOT b ON {", ".join(_AXES)} INTO NAME axis VALUE move), x(tag, axis, sign) AS (VALUES {", ".join(f"('{t}', '{a}', {s})" for t, (a, s) in T.TAG_AXIS.items())}),
t AS (SELECT p_partkey, one AS tag FROM b UNION SELECT p_partkey, two FROM b)"""


def tagged(spark, sf_dir) -> DataFrame:
    """(p_partkey, tags, styled, moves: map of axis to move)."""
    tag = lambda c: F.element_at(F.lit(_TAGS), (F.col(c) % len(_TAGS) + 1).cast("int"))
    moves = F.create_map(*[x for a, e in _MOVE.items() for x in (F.lit(a), F.expr(e).cast("double"))])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.array(tag("p_partkey"), tag("p_size"))).alias("tags"), (F.col("p_partkey") % 7 == 0).alias("styled"), moves.alias("moves"))


def _axis_of() -> tuple:
    axis = F.create_map(*[F.lit(x) for t, (a, _) in T.TAG_AXIS.items() for x in (t, a)])
    sign = F.create_map(*[F.lit(x) for t, (_, s) in T.TAG_AXIS.items() for x in (t, s)])
    return axis, sign


@query(
    f"""WITH {_TAGGED}, n AS (SELECT t.p_partkey, 'tag_not_backed:' || t.tag AS issue FROM t JOIN x USING (tag) JOIN m ON m.p_partkey = t.p_partkey AND m.axis = x.axis WHERE x.sign * m.move < 1.0),
    u AS (SELECT m.p_partkey, 'unmentioned_behavior:' || m.axis AS issue FROM m WHERE NOT styled AND axis IN {MAJOR_AXES} AND abs(move) >= 2.0 AND NOT EXISTS (SELECT 1 FROM t JOIN x USING (tag) WHERE t.p_partkey = m.p_partkey AND x.axis = m.axis))
    SELECT p_partkey, string_agg(issue, '|' ORDER BY issue) AS issues FROM (SELECT * FROM n UNION ALL SELECT * FROM u) GROUP BY ALL"""
)
def tag_behavior_issues(spark, sf_dir):
    """Tags that the measured moves don't back, and large moves that no tag mentions (unless a style covers the row)."""
    axis, sign = _axis_of()
    rows = tagged(spark, sf_dir)
    unbacked = F.transform(F.filter("tags", lambda t: sign[t] * F.col("moves")[axis[t]] < BACKED), lambda t: F.concat(F.lit("tag_not_backed:"), t))
    named = F.transform("tags", lambda t: axis[t])
    open_ = F.filter(F.lit(list(MAJOR_AXES)), lambda a: (F.abs(F.col("moves")[a]) >= MAJOR) & ~F.array_contains(named, a))
    silent = F.when(~F.col("styled"), F.transform(open_, lambda a: F.concat(F.lit("unmentioned_behavior:"), a))).otherwise(F.array().cast("array<string>"))
    issues = F.array_sort(F.concat(unbacked, silent))
    return rows.select("p_partkey", F.array_join(issues, "|").alias("issues")).where("issues <> ''")


@query(
    f"""WITH {_TAGGED}, s AS (SELECT t.p_partkey, x.sign * m.move >= CASE WHEN m.axis IN {T.CHROMA_AXES} THEN 1.0 ELSE 1.5 END AS ok FROM t JOIN x USING (tag) JOIN m ON m.p_partkey = t.p_partkey AND m.axis = x.axis)
    SELECT CASE WHEN passed THEN 'pass' ELSE 'fail' END AS status, count(*) AS n FROM (SELECT bool_and(ok) AS passed FROM s GROUP BY p_partkey) GROUP BY ALL"""
)
def direction_by_tags(spark, sf_dir):
    """Rows all of whose tags moved their axis the right way by its smallest perceptible change."""
    axis, sign = _axis_of()
    floor = lambda a: F.when(a.isin(*T.CHROMA_AXES), 1.0).otherwise(1.5)
    ok = F.forall("tags", lambda t: sign[t] * F.col("moves")[axis[t]] >= floor(axis[t]))
    return tagged(spark, sf_dir).groupBy(F.when(ok, "pass").otherwise("fail").alias("status")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_TAGGED} SELECT p_partkey, string_agg(axis || '=' || CASE WHEN abs(move) < 1.5 THEN 'slight' WHEN abs(move) < 3 THEN 'moderate' WHEN abs(move) < 6 THEN 'strong' ELSE 'extreme' END, ', ' ORDER BY axis) AS summary FROM m WHERE abs(move) >= 1.0 GROUP BY ALL"""
)
def intensity_summary(spark, sf_dir):
    """How strong each measured move is, in words, for moves that can be told at all."""
    told = F.filter(F.array_sort(F.map_entries("moves")), lambda e: F.abs(e["value"]) >= BACKED)
    words = F.array_join(F.transform(told, lambda e: F.concat(e["key"], F.lit("="), T.magnitude_bucket(e["value"]))), ", ")
    return tagged(spark, sf_dir).select("p_partkey", words.alias("summary")).where("summary <> ''")


@query(
    f"""WITH {_TAGGED} SELECT p_partkey, string_agg('  - ' || axis || ' = ' || format('{{:+.3f}}', move::DOUBLE) || ' -> ' || CASE WHEN abs(move) < 1.0 THEN 'negligible' WHEN move > 0 THEN 'up' ELSE 'down' END, chr(10) ORDER BY axis) AS summary
    FROM m WHERE axis IN {MAJOR_AXES} GROUP BY ALL"""
)
def behavior_summary(spark, sf_dir):
    """The main moves as signed lines; below the smallest move that backs a tag a direction is negligible."""
    told = F.filter(F.array_sort(F.map_entries("moves")), lambda e: e["key"].isin(*MAJOR_AXES))
    word = lambda v: F.when(F.abs(v) < BACKED, "negligible").when(v > 0, "up").otherwise("down")
    lines = F.transform(told, lambda e: F.concat(F.lit("  - "), e["key"], F.lit(" = "), F.format_string("%+.3f", e["value"]), F.lit(" -> "), word(e["value"])))
    return tagged(spark, sf_dir).select("p_partkey", F.array_join(lines, "\n").alias("summary"))


@query(
    f"""WITH {_DECISIONS}, a AS (SELECT source, count(*) AS rows, count(*) FILTER (syntax_pass) AS valid, count(*) FILTER (route = 'refuse') AS unsupported, count(*) FILTER (route = 'refuse' AND refused) AS caught, count(*) FILTER (route = 'grade') AS graded, count(*) FILTER (route = 'grade' AND refused) AS over FROM r GROUP BY source),
    w AS (SELECT *, valid AS k, rows AS n FROM a)
    SELECT source, rows, round(valid / rows::DOUBLE, 4) AS valid_rate, round({_wilson_sql(0)}, 4) AS valid_low, round({_wilson_sql(1)}, 4) AS valid_high, round(caught / nullif(unsupported, 0)::DOUBLE, 4) AS recall, round(over / nullif(graded, 0)::DOUBLE, 4) AS over_refusal FROM w"""
)
def frontier_score(spark, sf_dir):
    """A row per model (sources stand in): valid outputs with their interval, recall of refusals, refusals of good requests."""
    rows = decisions(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("rows"), F.count_if("syntax_pass").alias("valid"), F.count_if(F.expr("route = 'refuse'")).alias("unsupported"), F.count_if(F.expr("route = 'refuse' AND refused")).alias("caught"),
        F.count_if(F.expr("route = 'grade'")).alias("graded"), F.count_if(F.expr("route = 'grade' AND refused")).alias("over"),
    )
    lower, upper = S.wilson(F.col("valid"), F.col("rows"))
    return rows.select("source", "rows", F.round(F.col("valid") / F.col("rows"), 4).alias("valid_rate"), F.round(lower, 4).alias("valid_low"), F.round(upper, 4).alias("valid_high"), F.expr("round(caught / nullif(unsupported, 0), 4)").alias("recall"), F.expr("round(over / nullif(graded, 0), 4)").alias("over_refusal"))
