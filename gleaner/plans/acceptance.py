"""The twelve acceptance criteria and the registry of gates; documents and labels stand in for training rows and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acceptance as A
from ..registry import query
from ..sources.tables import table
from .evaluation import _wilson_sql

#: a training row made of a document and its label, in SQL that both engines read
_AS_ROW = {
    "id": "cast(doc_id AS {text})", "family": "source", "supported": "doc_id % 4 <> 0", "measured": "doc_id % 101 <> 3", "domain": f"CASE WHEN doc_id % 997 = 1 THEN 'log' ELSE '{A.CANONICAL_DOMAIN}' END",
    "tier": "CASE WHEN doc_id % 3 = 0 THEN 'gold' ELSE 'diagnostic_only' END", "category": "CASE WHEN doc_id % 4 = 0 THEN 'kind ' || cast(doc_id % 36 AS {text}) END", "mixed": "doc_id % 40 = 0", "image_path": "CASE WHEN doc_id % 7 <> 5 THEN 'images/x.png' END",
    "n_codes": "CASE WHEN doc_id % 211 = 5 THEN 63 ELSE 64 END", "code": "cast(doc_id % 257 AS int)", "tokenizer_version": "CASE WHEN doc_id % 11 = 1 THEN 'pending_tokenizer' ELSE 'v1' END", "unmentioned": "CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END", "mismatch": "CASE WHEN doc_id % 60 = 9 THEN 2 ELSE 0 END",
}
_ROWS = "r AS (SELECT " + ", ".join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in _AS_ROW.items()) + " FROM documents)"
_STATUS = {
    "scale": ("n BETWEEN 10000 AND 15000", "fail", "n"), "no_dominance": ("largest <= 0.5 * n", "fail", "largest"), "no_leakage": ("true", "fail", "0"), "provenance_and_behavior": ("unmeasured = 0", "fail", "unmeasured"),
    "canonical_domain": ("off_domain = 0", "fail", "off_domain"), "representability_and_recon": ("unmade = 0", "pending", "unmade"), "tags_backed_by_checks": ("issues = 0", "fail", "issues"), "unmentioned_behavior_handled": ("unmentioned = 0", "fail", "unmentioned"),
    "unsupported_coverage": ("refusals > 0 AND mixed AND categories >= 8", "pending", "categories"), "manifests_present": ("false", "pending", "1"), "expert_source_capped": ("true", "fail", "0"), "generic_input_support": ("no_image = 0", "pending", "no_image"),
}


@query(
    f"""WITH {_ROWS}, f AS (SELECT count(*) AS n, count(*) FILTER (supported AND NOT measured) AS unmeasured, count(*) FILTER (supported AND domain <> '{A.CANONICAL_DOMAIN}') AS off_domain,
      count(*) FILTER (supported AND (n_codes <> 64 OR code > 255 OR tokenizer_version = 'pending_tokenizer')) AS unmade, sum(unmentioned + mismatch) AS issues, sum(unmentioned) AS unmentioned, count(*) FILTER (NOT supported) AS refusals,
      count(DISTINCT category) AS categories, coalesce(bool_or(mixed AND NOT supported), false) AS mixed, count(*) FILTER (supported AND image_path IS NULL) AS no_image FROM r),
    l AS (SELECT max(k) AS largest FROM (SELECT count(*) AS k FROM r GROUP BY family)),
    c AS (SELECT unnest([{", ".join(f"({i + 1}, '{name}', CASE WHEN {test} THEN 'pass' ELSE '{other}' END, ({count})::BIGINT)" for i, (name, (test, other, count)) in enumerate(_STATUS.items()))}]) AS c FROM f, l),
    x AS (SELECT c[1] AS place, c[2] AS criterion, c[3] AS status, c[4] AS count FROM c)
    SELECT place, criterion, status, count FROM x UNION ALL SELECT 0, 'overall', CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'pending') THEN 'pending' ELSE 'pass' END, count(*) FILTER (status <> 'pass') FROM x"""
)
def training_acceptance(spark, sf_dir):
    """The twelve criteria on training rows made of the documents."""
    rows = table(spark, sf_dir, "documents").select(*[F.expr(e.format(text="string")).alias(c) for c, e in _AS_ROW.items()])
    issues = F.concat(F.array_repeat(F.lit("unmentioned_behavior:x"), F.col("unmentioned")), F.array_repeat(F.lit("contradicted:y"), F.col("mismatch")))
    rows = rows.withColumn("target_tokens", F.array_repeat("code", F.col("n_codes"))).withColumn("tag_issues", issues)
    return A.acceptance(rows, leaks=False, models_present=False)


#: What is measured of gate number g: every document takes part in some gates, and is a success of some.
_HELD = "doc_id % 7 <= g % 7"
_HIT = "(doc_id * 31 + g * 17) % 100 < 40 + (g * 23) % 61"
_KINDS = {g.kind: None for g in A.GATES}
_LISTED = ", ".join(f"({i + 1}, '{g.split}', '{g.metric}', '{g.kind}', '{g.side}', {'NULL' if g.bound is None else g.bound}, {g.units}, '{g.family}')" for i, g in enumerate(A.GATES))
_VERDICTS = f"""g(g, split, metric, kind, side, bound, units, family) AS (VALUES {_LISTED}),
    m AS (SELECT g, count(*) AS n, count(*) FILTER ({_HIT}) AS k FROM documents, g WHERE kind <> 'any_of' AND g % 9 <> 4 AND {_HELD} GROUP BY g),
    w AS (SELECT g.*, m.n, m.k, m.k / m.n::DOUBLE - 0.5 AS low, {_wilson_sql(0)} AS wl, {_wilson_sql(1)} AS wu FROM g LEFT JOIN m USING (g)),
    a AS (SELECT max(n) AS n, max(low) FILTER (n >= 150) AS low FROM w WHERE metric = 'supported_prompt_to_lut_pass_rate_vs_deterministic_renderer' AND split IN ('eval_subtle_control', 'eval_style_discriminability')),
    v AS (SELECT w.g AS place, split, metric, family, coalesce(CASE WHEN kind = 'any_of' THEN a.n ELSE w.n END, 0)::BIGINT AS n, bound::DOUBLE AS bound, kind, side, units,
      CASE kind WHEN 'any_of' THEN a.low WHEN 'interval' THEN w.low WHEN 'wilson' THEN CASE WHEN side = 'most' THEN wu ELSE wl END END AS value FROM w, a),
    y AS (SELECT * REPLACE (CASE WHEN n >= units THEN value END AS value) FROM v),
    z AS (SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN kind = 'diagnostic' THEN 'diagnostic' WHEN value IS NULL THEN 'not-evaluable-below-min_N' WHEN (side = 'most' AND value <= bound) OR (side = 'over' AND value > bound) OR (side = 'least' AND value >= bound) THEN 'pass' ELSE 'fail' END AS verdict FROM y)"""


def _verdicts(spark, sf_dir):
    listed = spark.createDataFrame([(i + 1, g.split, g.metric) for i, g in enumerate(A.GATES) if g.kind != "any_of" and (i + 1) % 9 != 4], "g int, split string, metric string")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(len(A.GATES)))).alias("g")).where(_HELD)
    counts = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.expr(_HIT)).alias("k"))
    return A.gate_verdicts(counts.join(F.broadcast(listed), "g").select("split", "metric", "k", "n", (F.col("k") / F.col("n") - 0.5).alias("low")))


@query(f"WITH {_VERDICTS} SELECT place, split, metric, n, round(value, 6) AS value, verdict FROM z")
def gate_registry(spark, sf_dir):
    """All gates of the registry, each held against what was measured of it."""
    return _verdicts(spark, sf_dir).select("place", "split", "metric", "n", F.round("value", 6).alias("value"), "verdict")


@query(f"WITH {_VERDICTS} SELECT family, CASE WHEN family = 'diagnostic' THEN 'diagnostic' WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_and(verdict = 'pass') THEN 'pass' ELSE 'pending' END AS verdict, count(*) AS gates, count(*) FILTER (verdict = 'pass') AS passed FROM z GROUP BY family")
def gate_families(spark, sf_dir):
    """Whether each family of gates passes."""
    return A.families(_verdicts(spark, sf_dir))
