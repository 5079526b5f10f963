"""Attribute specs and output parsing; line items stand in for measured behaviours, events for emitted codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spec as P
from ..operators.parsing import parse_output, project_codes
from ..registry import query
from ..sources.tables import table

#: measured fields derived from a line item, in expressions that both engines read alike
FIELDS = {
    "temperature_delta_b": "(l_quantity - 25) / 5.0",
    "mean_l_delta": "(l_discount - 0.05) * 100.0",
    "chroma_delta": "(l_tax - 0.04) * 75.0",
    "split_tone_strength": "l_quantity / 20.0",
    "shadow_hue_deg": "(l_partkey * 7) % 360",
    "highlight_hue_deg": "(l_suppkey * 11) % 360",
    "sat_red": "(l_linenumber - 4) * 0.75",
}
_BUCKET = "CASE WHEN abs({v}) < 1.5 THEN 'slight' WHEN abs({v}) < 3 THEN 'moderate' WHEN abs({v}) < 6 THEN 'strong' ELSE 'extreme' END"


def _signed(v: str) -> str:
    return f"(CASE WHEN round_even({v}, 1) < 0 THEN '-' ELSE '+' END || printf('%.1f', abs(round_even({v}, 1))))"


def _spec_sql(bucketed: bool) -> str:
    shown = (lambda v: _BUCKET.format(v=f"round_even({v}, 1)")) if bucketed else (lambda v: _signed(f"abs({v})"))
    parts = {}
    for name, (up, down) in P.BIPOLAR.items():
        if name in FIELDS:
            parts[up] = f"CASE WHEN abs({name}) >= 0.5 AND round_even({name}, 1) >= 0 THEN '{up}=' || {shown(name)} END"
            parts[down] = f"CASE WHEN abs({name}) >= 0.5 AND round_even({name}, 1) < 0 THEN '{down}=' || {shown(name)} END"
    for key, name in P.UNIPOLAR.items():
        if name in FIELDS:
            parts[key] = f"CASE WHEN {name} >= 0.5 THEN '{key}=' || {shown(name)} END"
    for key, (name, gate) in P.HUES.items():
        if gate in FIELDS:
            parts[key] = f"CASE WHEN {gate} >= 1.0 THEN '{key}=' || {name}::BIGINT END"
    body = f"CASE WHEN sat_red >= 0 THEN '+' ELSE '-' END || {_BUCKET.format(v='round_even(sat_red, 1)')}" if bucketed else _signed("sat_red")
    parts["sat_red"] = f"CASE WHEN abs(sat_red) >= 1.0 THEN 'sat_red=' || {body} END"
    return "'route=grade | ' || concat_ws(' ', " + ", ".join(parts[k] for k in P.ORDER if k in parts) + ")"


_FIELDS_SQL = "m AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{e.replace('/ ', '/ ')} AS {n}" for n, e in FIELDS.items()) + " FROM lineitem)"


def _measured(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).cast("double").alias(n) for n, e in FIELDS.items()])


def _fields():
    return {n: F.col(n) for n in FIELDS}


@query(f"WITH {_FIELDS_SQL} SELECT l_orderkey, l_linenumber, {_spec_sql(False)} AS spec FROM m")
def spec_serialize(spark, sf_dir):
    return _measured(spark, sf_dir).select("l_orderkey", "l_linenumber", P.serialize(_fields()).alias("spec"))


@query(f"WITH {_FIELDS_SQL} SELECT l_orderkey, l_linenumber, {_spec_sql(True)} AS spec FROM m")
def spec_bucketed(spark, sf_dir):
    return _measured(spark, sf_dir).select("l_orderkey", "l_linenumber", P.serialize(_fields(), bucketed=True).alias("spec"))



@query("SELECT count(*) AS n, count(*) AS exact FROM lineitem")
def spec_parse_roundtrip(spark, sf_dir):
    """Every written axis must come back with the value it was written with."""
    rows = _measured(spark, sf_dir).withColumn("spec", P.serialize(_fields()))
    rows = rows.withColumn("axes", P.axes(F.col("spec")))
    ok = F.lit(True)
    for name in FIELDS:
        value = F.bround(name, 0 if name.endswith("deg") else 1)
        gate = "split_tone_strength" if name.endswith("deg") else name
        least = P.SATURATION if name.startswith("sat_") or name.endswith("deg") else P.MAGNITUDE
        written = (F.abs(gate) if not name.endswith("deg") else F.col(gate)) >= least
        ok = ok & F.when(written, F.element_at("axes", F.lit(name)) == value).otherwise(~F.map_contains_key("axes", F.lit(name)))
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("exact"))


_PRED = {"temperature_delta_b": "(l_quantity - 22) / 5.0", "mean_l_delta": "(0.05 - l_discount) * 80.0 + l_linenumber % 2 * 4.0"}


def _axes_sql(fields: dict[str, str]) -> str:
    return "map_from_entries(list_filter([" + ", ".join(f"CASE WHEN abs({e}) >= 0.5 THEN ('{n}', round_even({e}, 1)::DOUBLE) END" for n, e in fields.items()) + "], lambda x: x IS NOT NULL))"


def _share_sql(a: str, b: str, how: str) -> str:
    theirs = f"coalesce({b}[k], 0)"
    mine = f"{a}[k]"
    same = f"{theirs} <> 0 AND ({mine} > 0) = ({theirs} > 0)"
    test = {
        "sign": same,
        "bucket": f"{same} AND {_BUCKET.format(v=mine)} = {_BUCKET.format(v=theirs)}",
        "value": f"({mine} * {theirs} > 0 OR abs({mine}) < 0.5) AND abs({mine} - {theirs}) <= greatest(1.0, 0.25 * abs({mine}))",
    }[how]
    return f"(CASE WHEN cardinality({a}) = 0 THEN 1.0 ELSE len(list_filter(map_keys({a}), lambda k: {test}))::DOUBLE / cardinality({a}) END)"


def _f1_sql(how: str) -> str:
    p, r = _share_sql("pred", "gold", how), _share_sql("gold", "pred", how)
    return f"round(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END, 6)"


_GOLD = {n: FIELDS[n] for n in _PRED}


@query(
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_axes_sql(_PRED)} AS pred, {_axes_sql(_GOLD)} AS gold FROM lineitem)
    SELECT l_orderkey, l_linenumber, {_f1_sql('sign')} AS direction_f1, {_f1_sql('bucket')} AS bucket_f1, {_f1_sql('value')} AS attribute_f1 FROM s"""
)
def spec_compare_f1(spark, sf_dir):
    """Predicted specs, as text, against gold specs, as text."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).cast("double").alias(f"p_{n}") for n, e in _PRED.items()], *[F.expr(e).cast("double").alias(f"g_{n}") for n, e in _GOLD.items()])
    texts = rows.select("l_orderkey", "l_linenumber", P.serialize({n: F.col(f"p_{n}") for n in _PRED}).alias("p"), P.serialize({n: F.col(f"g_{n}") for n in _GOLD}).alias("g"))
    scores = texts.select("l_orderkey", "l_linenumber", P.compared(F.col("p"), F.col("g")).alias("s"))
    return scores.select("l_orderkey", "l_linenumber", *[F.round(f"s.{how}", 6).alias(f"{name}_f1") for name, how in (("direction", "sign"), ("bucket", "bucket"), ("attribute", "value"))])


@query(
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_axes_sql(_PRED)} AS pred, {_axes_sql(_GOLD)} AS gold FROM lineitem)
    SELECT l_orderkey, l_linenumber, {_share_sql('pred', 'gold', 'value')} = 1.0 AS backed FROM s"""
)
def backing_check(spark, sf_dir):
    """Whether every asserted axis is borne out by the measurement in sign and size."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.serialize({n: F.expr(e) for n, e in _PRED.items()}).alias("p"), P.serialize({n: F.expr(e) for n, e in _GOLD.items()}).alias("g"))
    return rows.select("l_orderkey", "l_linenumber", (P.borne_out(F.col("p"), F.col("g")) == 1.0).alias("backed"))


#: an event stands in for a model output: its id picks the kind of text
_OUTPUT = {
    "good": "'<lut_bos> ' || {codes} || ' <lut_eos>'", "refusal": "'  <unsupported> '", "short": "'<lut_bos> <lut_001> <lut_eos>'", "prose": "'Here is your grade'", "range": "'<lut_bos> ' || {codes63} || ' <lut_300> <lut_eos>'",
    "mixed": "'<unsupported> ' || {codes}", "empty": "'   '", "open": "{codes}",
}
_SPARK_CODES = "array_join(transform(sequence(0, {n}), i -> format_string('<lut_%03d>', (event_id * 31 + i * 7) % 256)), ' ')"
_DUCK_CODES = "array_to_string(list_transform(range(0, {n} + 1), lambda i: printf('<lut_%03d>', (event_id * 31 + i * 7) % 256)), ' ')"


def _text(codes: str) -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {x.format(codes=codes.format(n=63), codes63=codes.format(n=62))}" for i, x in enumerate(_OUTPUT.values())) + " END"


def _outputs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(_text(_SPARK_CODES)).alias("text"))


_PARSED = f"""WITH o AS (SELECT event_id, trim({_text(_DUCK_CODES)}) AS s FROM events), t AS (SELECT event_id, s, string_split_regex(s, '\\s+') AS t FROM o),
c AS (SELECT *, list_filter(t[2:-2], lambda x: regexp_full_match(x, '<lut_[0-9]{{3}}>') AND try_cast(substr(x, 6, 3) AS INTEGER) <= 255) AS ok FROM t)"""


@query(
    f"""{_PARSED} SELECT event_id, CASE WHEN s = '<unsupported>' THEN 'unsupported' WHEN s = '' OR list_contains(t, '<unsupported>') OR t[1] <> '<lut_bos>' OR t[-1] <> '<lut_eos>' THEN 'invalid'
    WHEN len(ok) = 64 AND len(t) = 66 THEN 'lut_tokens' ELSE 'invalid' END AS kind,
    CASE WHEN s = '<unsupported>' OR s = '' OR list_contains(t, '<unsupported>') OR t[1] <> '<lut_bos>' OR t[-1] <> '<lut_eos>' THEN 0 ELSE len(ok) END::INTEGER AS codes,
    CASE WHEN s = '<unsupported>' THEN '' WHEN s = '' THEN 'empty_output' WHEN list_contains(t, '<unsupported>') THEN 'mixed_unsupported_and_tokens'
    WHEN t[1] <> '<lut_bos>' OR t[-1] <> '<lut_eos>' THEN concat_ws('|', CASE WHEN t[1] <> '<lut_bos>' THEN 'missing_bos' END, CASE WHEN t[-1] <> '<lut_eos>' THEN 'missing_eos' END)
    ELSE concat_ws('|', nullif(array_to_string(list_transform(list_filter(t[2:-2], lambda x: regexp_full_match(x, '<lut_[0-9]{{3}}>') AND try_cast(substr(x, 6, 3) AS INTEGER) > 255), lambda x: 'code_out_of_range:' || x), '|'), ''),
      CASE WHEN len(ok) <> 64 OR len(t) <> 66 THEN 'token_count_' || len(ok) || '_not_64' END) END AS errors FROM c"""
)
def parse_outputs(spark, sf_dir):
    p = parse_output(F.col("text"))
    rows = _outputs(spark, sf_dir).withColumn("p", p)
    return rows.select("event_id", "p.kind", F.size("p.codes").alias("codes"), F.array_join("p.errors", "|").alias("errors"))


@query(
    f"""{_PARSED} SELECT event_id, CASE WHEN t[1] = '<unsupported>' THEN '<unsupported>' ELSE '<lut_bos> ' || array_to_string(list_concat(
    list_filter(t, lambda x: regexp_full_match(x, '<lut_[0-9]{{3}}>') AND try_cast(substr(x, 6, 3) AS INTEGER) <= 255), list_transform(range(64), lambda i: '<lut_000>'))[1:64], ' ') || ' <lut_eos>' END AS projected FROM c"""
)
def fsm_project(spark, sf_dir):
    """The nearest valid output: the refusal, or begin, the first 64 codes padded with code 0, end."""
    return _outputs(spark, sf_dir).select("event_id", project_codes(F.col("text")).alias("projected"))


@query(
    f"""WITH {_FIELDS_SQL}, s AS (SELECT l_orderkey, l_linenumber, {_spec_sql(False)} AS spec FROM m), t AS (SELECT *, string_split(string_split(spec, ' | ')[2], ' ') AS t FROM s)
    SELECT l_orderkey, l_linenumber, CASE WHEN spec LIKE '%| %=%' THEN 'route=grade | ' || array_to_string(list_transform(list_sort(list_transform(t, lambda x: {{'h': md5('5:' || l_orderkey || ':' || x), 't': x}})), lambda s: s.t), ' ') ELSE spec END AS spec FROM t"""
)
def spec_shuffle(spark, sf_dir):
    """Axis tokens in a hashed order, as training input."""
    return spec_serialize(spark, sf_dir).select("l_orderkey", "l_linenumber", P.shuffled(F.col("spec"), F.col("l_orderkey"), 5).alias("spec"))


@query("SELECT count(*) AS n, count(*) AS bounded, count(*) AS same_sign FROM lineitem")
def spec_jitter(spark, sf_dir):
    """Jittered magnitudes stay within 0.3 (and rounding) of their own, keep their sign and stay written."""
    axes = spec_serialize(spark, sf_dir).select("l_orderkey", P.axes(F.col("spec")).alias("a")).withColumn("j", P.jittered(F.col("a"), F.col("l_orderkey"), 5))
    gap = F.forall(F.map_entries("a"), lambda e: F.abs(e["value"] - F.element_at("j", e["key"])) <= 0.3501)
    sign = F.forall(F.map_entries("a"), lambda e: e["value"] * F.element_at("j", e["key"]) >= 0)
    return axes.agg(F.count("*").alias("n"), F.count_if(gap).alias("bounded"), F.count_if(sign).alias("same_sign"))
