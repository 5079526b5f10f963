"""Queries over plugged-in operators, and the bootstrap with resamples of fixed size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.hooks import Hooks
from ..operators.resampling import stratified_bootstrap
from ..registry import query
from ..sources.tables import table
from .evaluation import PAIRED_REPLICATES, _paired

HOOKS = Hooks()
# What the decoder-free baselines say.
UNSUPPORTED = "<unsupported>"
FIXED = " ".join(["<lut>", *["<lut_000>"] * 64, "</lut>"])


def _last_words(batch: pa.RecordBatch) -> pa.Array:
    """The last word of each text."""
    return pa.array([(t or "").split(" ")[-1] for t in batch.column(0).to_pylist()], pa.string())


def _shouting(batch: pa.RecordBatch) -> pa.Array:
    """Whether more than one letter in twenty is a capital one."""
    texts = batch.column(0).to_pylist()
    return pa.array([None if t is None else 20 * sum("A" <= c <= "Z" for c in t) > sum("a" <= c.lower() <= "z" for c in t) for t in texts], pa.bool_())


HOOKS.add("predict", "null_always_unsupported", column=lambda text: F.lit(UNSUPPORTED))
HOOKS.add("predict", "fixed_tokens", column=lambda text: F.lit(FIXED))
HOOKS.add("predict", "last_word", arrow=_last_words)
HOOKS.add("predict", "frozen", gate=lambda: "needs a frozen configuration")
HOOKS.add("judge", "short", column=lambda text: F.length(text) < 400)
HOOKS.add("judge", "shouting", arrow=_shouting)
_ADAPTERS = ["null_always_unsupported", "fixed_tokens", "last_word", "frozen", "unheard_of"]
_PREDICTED = f"""p AS (SELECT doc_id, a.name, CASE a.name WHEN 'null_always_unsupported' THEN '{UNSUPPORTED}' WHEN 'fixed_tokens' THEN '{FIXED}' WHEN 'last_word' THEN string_split(coalesce(text, ''), ' ')[-1] END AS out,
    CASE a.name WHEN 'frozen' THEN 'needs a frozen configuration' WHEN 'unheard_of' THEN 'absent' END AS reason FROM documents, (VALUES {", ".join(f"('{n}')" for n in _ADAPTERS)}) a(name))"""


@query(f"WITH {_PREDICTED} SELECT name, any_value(reason) AS reason, count(*) AS rows, count(out) AS given, coalesce(sum(strlen(out)), 0)::BIGINT AS bytes, count(DISTINCT out) AS different FROM p GROUP BY name")
def adapter_outputs(spark, sf_dir):
    """What each adapter says of every document; gated and absent ones are reported with their reason."""
    said = HOOKS.all_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "predict", _ADAPTERS, ["text"])
    return said.groupBy(F.col("predict_name").alias("name")).agg(F.max("predict_reason").alias("reason"), F.count("*").alias("rows"), F.count("predict").alias("given"), F.coalesce(F.sum(F.octet_length("predict")), F.lit(0)).cast("long").alias("bytes"), F.countDistinct("predict").alias("different"))


@query(
    """WITH r AS (SELECT source, text, n_chars % 5 = 0 AS det FROM documents), j AS (
      SELECT 'short' AS judge_name, source, det, coalesce(length(text) < 400, false) AS judged FROM r
      UNION ALL SELECT 'shouting', source, det, coalesce(20 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')), false) FROM r
      UNION ALL SELECT 'none', source, det, false FROM r)
    SELECT judge_name, source, count(*) AS n, count(*) FILTER (det) AS by_rule, count(*) FILTER (judged) AS by_judge, count(*) FILTER (det OR judged) AS caught FROM j GROUP BY ALL"""
)
def catch_by_judges(spark, sf_dir):
    """How many of each source's texts a rule or a pluggable judge catches; a judge that is absent flags nothing."""
    rows = table(spark, sf_dir, "documents").select("source", "text", (F.col("n_chars") % 5 == 0).alias("det"))
    told = HOOKS.all_of(rows, "judge", ["short", "shouting", "none"], ["text"]).withColumn("judged", F.coalesce("judge", F.lit(False)))
    return told.groupBy("judge_name", "source").agg(F.count("*").alias("n"), F.count_if("det").alias("by_rule"), F.count_if("judged").alias("by_judge"), F.count_if(F.col("det") | F.col("judged")).alias("caught"))


@query()
def stratified_bootstrap_whole(spark, sf_dir):
    """Mean difference of paired outcomes, resampled within languages at their own sizes."""
    rows = _paired(spark, sf_dir).select("lang", F.expr("cast(x AS int) - cast(y AS int)").alias("delta"))
    return stratified_bootstrap(rows, "delta", "lang", PAIRED_REPLICATES, 5).select(*[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")], "units", "replicates")
