"""Reports around a run: summaries, tails, examples, notebooks, payloads; the test tables stand in for its records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import held_out, sql_sha1_bucket
from ..functions.let import let
from ..operators import stats as S
from ..operators.selection import numbered
from ..operators.spatial import plane_r2
from ..registry import query
from ..sources.tables import table
from .assembly import _CACHE, _cache
from .evaluation import _DECISIONS, PAIRED_REPLICATES, _draw_sql, _poisson_sql, _wilson_sql, decisions, metric_counts
from .splits import _ASSIGNED, split_assignment

# Words of a path that hint at a style.
STYLE_HINTS = ("cinematic", "vintage", "retro", "film", "moody", "portrait", "landscape", "nature", "wildlife", "teal", "orange", "bw", "mono", "black", "white", "warm", "cool", "fade", "faded", "matte", "kodak", "fuji", "polaroid", "wedding", "travel", "urban", "vlog", "drone", "log", "rec709", "blockbuster", "analog", "sepia", "duotone")
# Fields that may hold an instruction's text; a notebook's metric line and signs of failure.
TEXT_FIELDS = ("text", "instruction", "prompt", "user_want", "content")
METRIC_LINE = r"(?i)\bMETRIC\s*=\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
FAILURES = ("[bridge][ABORT]", "[sft][ABORT]", "[score][ABORT]", "Traceback (most recent call last)")
FAMILY_MEAN, FAMILY_P95, FAMILY_ROWS = 2.5, 5.0, 30  # a family's limits and the rows from which they hold


_DETECTED = f"{_DECISIONS}, d AS (SELECT doc_id, 2 * (NOT is_supported AND refused)::INTEGER AS num, (NOT is_supported)::INTEGER + refused::INTEGER AS den FROM r WHERE NOT is_supported OR refused)"


@query(
    f"""WITH {_DETECTED}, w AS (SELECT k, num, den, {_poisson_sql(_draw_sql(11, 'k', 'doc_id'))} AS w FROM d, range(200) t(k)), e AS (SELECT k, sum(w * num) / nullif(sum(w * den), 0)::DOUBLE AS x FROM w GROUP BY k)
    SELECT (SELECT round(sum(num) / sum(den)::DOUBLE, 6) FROM d) AS f1, round(quantile_cont(x, 0.025), 6) AS low FROM e"""
)
def bootstrap_f1(spark, sf_dir, replicates: int = 200):
    """F1 of the refusal detector with its lower bound; with few replicates, for the SQL to follow.

    F1 is 2 tp / (2 tp + fp + fn), a ratio of sums, to which right non-refusals add nothing; they are never drawn.
    """
    rows = decisions(spark, sf_dir).where("NOT is_supported OR refused")
    missed, hit = (~F.col("is_supported")).cast("int"), F.col("refused").cast("int")
    return S.bootstrap_ratio(rows.select("doc_id", (2 * missed * hit).alias("num"), (missed + hit).alias("den")), "num", "den", "doc_id", replicates, 11).select(F.round("estimate", 6).alias("f1"), F.round("low", 6).alias("low"))


@query()
def bootstrap_f1_whole(spark, sf_dir):
    """bootstrap_f1 with the number of replicates to report."""
    return bootstrap_f1(spark, sf_dir, PAIRED_REPLICATES)


#: what the interpreter made of a decision, its attribute score and whether its table is procedural
_PRED = "CASE WHEN refused THEN 'refuse' WHEN syntax_pass THEN 'grade' ELSE 'clarify' END"
_SUMMARY = {
    "route_accuracy": ("true", "pred = route"),
    "recall_grade": ("route = 'grade'", "pred = route"),
    "recall_clarify": ("route = 'clarify'", "pred = route"),
    "recall_refuse": ("route = 'refuse'", "pred = route"),
    "refuse_kind_accuracy": ("route = 'refuse'", "pred = route AND mixed"),
    "over_refusal_rate": ("route = 'grade'", "pred <> 'grade'"),
}
_F1_SLICES = {"attribute_f1": "route = 'grade'", "attribute_f1_procedural": "route = 'grade' AND procedural", "attribute_f1_real": "route = 'grade' AND NOT procedural"}


@query(
    f"""WITH {_DECISIONS}, i AS (SELECT *, {_PRED} AS pred, doc_id % 11 / 10.0 AS f1, pair % 4 = 0 AS procedural FROM r),
    c AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (({p}) AND ({ok})) AS k, count(*) FILTER ({p}) AS n FROM i" for m, (p, ok) in _SUMMARY.items())}),
    u AS (SELECT source, avg(CASE WHEN pred = route THEN f1 ELSE 0 END) AS joint FROM i GROUP BY source)
    SELECT metric, n, round(k / nullif(n, 0)::DOUBLE, 6) AS value, round({_wilson_sql(0)}, 6) AS low, round({_wilson_sql(1)}, 6) AS high FROM c
    UNION ALL SELECT 'joint_by_unit', count(*), round(avg(joint), 6), NULL, NULL FROM u
    UNION ALL {" UNION ALL ".join(f"SELECT '{m}', count(*) FILTER ({p}), round(avg(CASE WHEN pred = route THEN f1 ELSE 0 END) FILTER ({p}), 6), NULL, NULL FROM i" for m, p in _F1_SLICES.items())}"""
)
def interpreter_summary(spark, sf_dir):
    """Routes, kinds and over-refusals with their intervals, the joint score by units, and attribute scores by slice.

    A missed route counts as a score of 0, as it has no axes to compare.
    """
    rows = decisions(spark, sf_dir).withColumns({"pred": F.expr(_PRED), "f1": F.expr("doc_id % 11 / 10D"), "procedural": F.expr("pair % 4 = 0")})
    low, high = S.wilson(F.col("k"), F.col("n"))
    rates = metric_counts(rows, _SUMMARY).select("metric", "n", F.round("rate", 6).alias("value"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
    joint = F.when(F.col("pred") == F.col("route"), F.col("f1")).otherwise(0.0)
    units = rows.groupBy("source").agg(F.avg(joint).alias("joint")).agg(F.count("*").alias("n"), F.round(F.avg("joint"), 6).alias("value"))
    sums = rows.agg(*[f.alias(f"{a}_{m}") for m, p in _F1_SLICES.items() for a, f in (("n", F.count_if(F.expr(p))), ("value", F.round(F.avg(F.when(F.expr(p), joint)), 6)))])
    slices = sums.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("n"), F.col(f"value_{m}").alias("value")) for m in _F1_SLICES])))
    return rates.unionByName(units.withColumn("metric", F.lit("joint_by_unit")).unionByName(slices), allowMissingColumns=True)


#: a line item is a node of a supplier's table: its part's key places it in a grid of 5 x 5 x 5
_EDGE = "(l_partkey % 5 IN (0, 4) OR l_partkey // 5 % 5 IN (0, 4) OR l_partkey // 25 % 5 IN (0, 4))"
_TABLES = f"t AS (SELECT l_suppkey AS id, l_suppkey % 7 AS family, sum(l_quantity) / (5.0::DOUBLE * count(l_quantity)) AS mean, sum(l_quantity) FILTER ({_EDGE}) / (5.0::DOUBLE * count(l_quantity) FILTER ({_EDGE})) AS boundary, sum(l_quantity) FILTER (NOT {_EDGE}) / (5.0::DOUBLE * count(l_quantity) FILTER (NOT {_EDGE})) AS interior FROM lineitem GROUP BY ALL)"


def table_errors(spark, sf_dir) -> DataFrame:
    """Mean difference of each table's nodes, of those on a face of the cube and of those inside."""
    node = F.expr("l_partkey % 5 IN (0, 4) OR (l_partkey div 5) % 5 IN (0, 4) OR (l_partkey div 25) % 5 IN (0, 4)")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("q"), node.alias("face"))
    mean = lambda q: F.try_divide(F.sum(q), F.lit(5.0) * F.count(q))  # noqa: E731  # sums of whole numbers are exact in any order, so a mean on a limit stays on it
    by = rows.groupBy("id").agg(mean(F.col("q")).alias("mean"), mean(F.when(F.col("face"), F.col("q"))).alias("boundary"), mean(F.when(~F.col("face"), F.col("q"))).alias("interior"))
    return by.withColumn("family", F.col("id") % 7)


@query(f"WITH {_TABLES} SELECT id, round(mean, 6) AS mean, round(boundary, 6) AS boundary, round(interior, 6) AS interior FROM t ORDER BY round(mean, 9) DESC, id LIMIT 10")
def worst_tables(spark, sf_dir):
    """The ten tables that are off most, ties to the smaller id: a distributed top-n."""
    return table_errors(spark, sf_dir).orderBy(F.desc(F.round("mean", 9)), "id").limit(10).select("id", *[F.round(c, 6).alias(c) for c in ("mean", "boundary", "interior")])


@query(
    f"""WITH {_TABLES}, f AS (SELECT family, count(*) AS n, avg(mean) AS m, quantile_cont(mean, 0.95) AS p95, count(*) FILTER (mean > {FAMILY_P95}) AS over, avg(interior / mean) FILTER (mean > {FAMILY_P95}) AS share FROM t GROUP BY family)
    SELECT family, n, round(m, 6) AS mean, round(p95, 6) AS p95, over, round(share, 6) AS interior_share, CASE WHEN n < {FAMILY_ROWS} THEN 'not_enforced' WHEN m <= {FAMILY_MEAN} AND p95 <= {FAMILY_P95} THEN 'pass' ELSE 'fail' END AS verdict FROM f"""
)
def family_tails(spark, sf_dir):
    """Each family's gate, its tables over the limit, and how much of their difference lies inside the cube."""
    over = F.col("mean") > FAMILY_P95
    by = table_errors(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.avg("mean").alias("m"), F.expr("percentile(mean, 0.95)").alias("p"), F.count_if(over).alias("over"), F.avg(F.when(over, F.col("interior") / F.col("mean"))).alias("share"))
    verdict = F.when(F.col("n") < FAMILY_ROWS, "not_enforced").when((F.col("m") <= FAMILY_MEAN) & (F.col("p") <= FAMILY_P95), "pass").otherwise("fail")
    return by.select("family", "n", F.round("m", 6).alias("mean"), F.round("p", 6).alias("p95"), "over", F.round("share", 6).alias("interior_share"), verdict.alias("verdict"))


_XYR = "s AS (SELECT l_suppkey % 40 AS image, (l_partkey % 64) / 63.0::DOUBLE AS x, (l_orderkey % 48) / 47.0::DOUBLE AS y, l_discount + (l_partkey % 64) / (200.0 + l_suppkey % 40 * 90) AS r FROM lineitem)"


@query(
    f"""WITH {_XYR}, m AS (SELECT image, avg(x) AS mx, avg(y) AS my, avg(r) AS mr FROM s GROUP BY image),
    c AS (SELECT image, sum((x - mx) ** 2) AS xx, sum((y - my) ** 2) AS yy, sum((x - mx) * (y - my)) AS xy, sum((x - mx) * (r - mr)) AS xr, sum((y - my) * (r - mr)) AS yr, any_value(mx) AS mx, any_value(my) AS my, any_value(mr) AS mr FROM s JOIN m USING (image) GROUP BY image),
    b AS (SELECT image, (xr * yy - yr * xy) / (xx * yy - xy * xy) AS bx, (yr * xx - xr * xy) / (xx * yy - xy * xy) AS b_y, mx, my, mr FROM c),
    e AS (SELECT image, sum((r - mr) ** 2) AS total, sum((r - mr - bx * (x - mx) - b_y * (y - my)) ** 2) AS left_over FROM s JOIN b USING (image) GROUP BY image)
    SELECT image, round(1 - left_over / total, 6) AS xy_r2 FROM e"""
)
def position_r2(spark, sf_dir):
    """How much of an image's residual a plane over its pixels' places explains; 0 for a constant residual or place.

    One pass of moments, added up in every partition: explained over total squares of the fit on (1, x, y).
    """
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 40).alias("image"), (F.col("l_partkey") % 64 / 63.0).alias("x"), (F.col("l_orderkey") % 48 / 47.0).alias("y"), F.expr("l_discount + (l_partkey % 64) / (200D + l_suppkey % 40 * 90)").alias("r"),
    )
    return rows.groupBy("image").agg(F.round(plane_r2("x", "y", "r"), 6).alias("xy_r2"))


_HINTS, _SHOWN = ("cold", "bolt", "cold", "PROMO", "no such words"), 8
_SPECS = "s AS (SELECT p_partkey AS id, p_type || ' ' || p_name AS spec FROM part WHERE p_size % 2 = 0)"


def _hints_sql() -> str:
    picks = []
    for i, hint in enumerate(_HINTS):
        used = " ".join(f"AND id NOT IN (SELECT id FROM h{j})" for j in range(i))
        picks.append(f"h{i} AS MATERIALIZED (SELECT id, {i} AS place, '{hint}' AS hint FROM s WHERE contains(spec, '{hint}') {used} ORDER BY id LIMIT 1)")
    union = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(len(_HINTS)))
    return f"WITH {_SPECS}, {', '.join(picks)}, p AS ({union}), f AS (SELECT id, 100 + row_number() OVER (ORDER BY id) AS place, NULL AS hint FROM s WHERE id NOT IN (SELECT id FROM p)) SELECT id, hint FROM (SELECT * FROM p UNION ALL SELECT * FROM f) ORDER BY place LIMIT {_SHOWN}"


def hinted(rows: DataFrame, text: str, hints: tuple[str, ...], k: int, key: str = "id") -> DataFrame:
    """(key, hint) of k examples: for each hint in turn its first row not yet taken, then the first rows left over.

    A hint needs no more than as many of its first rows as there are hints, so the choice is made among a number of
    rows that hints and k bound, each a distributed top-n.
    """
    places = [rows.where(F.contains(text, F.lit(h))).orderBy(key).limit(i + 1).select(key, F.lit(i).alias("hint_no")) for i, h in enumerate(hints)]
    first = rows.orderBy(key).limit(len(hints) + k).select(key, F.lit(len(hints)).alias("hint_no"))
    found = reduce(DataFrame.unionByName, places, first).groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("hint_no"), F.col(key).alias("key")))).alias("all"))

    def take(taken: Column, c: Column) -> Column:
        fresh = ~F.exists(taken, lambda t: t["key"] == c["key"]) & ((c["hint_no"] == len(hints)) | ~F.exists(taken, lambda t: t["hint_no"] == c["hint_no"])) & (F.size(taken) < k)
        return F.when(fresh, F.concat(taken, F.array(c))).otherwise(taken)

    none = F.filter(F.col("all"), lambda c: F.lit(False))
    chosen = found.select(F.explode(F.aggregate("all", none, take)).alias("c"))
    return chosen.select(F.col("c.key").alias(key), F.get(F.array(*[F.lit(h) for h in hints]), F.col("c.hint_no")).alias("hint"))


@query(_hints_sql())
def hinted_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("spec"))
    return hinted(rows, "spec", _HINTS, _SHOWN)


@query(
    f"""WITH p AS (SELECT page_id, 'web/' || split_part(split_part(url, '://', 2), '/', 1) || '/' || CASE page_id % 4 WHEN 0 THEN 'Warm-Film' WHEN 1 THEN 'teal_ORANGE.moody' WHEN 2 THEN 'Faded/black  white' ELSE 'plain' END || '/sepia.cube' AS path FROM pages)
    SELECT page_id, split_part(path, '/', 2) AS domain, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(list_slice(string_split(path, '/'), 1, -2), '/')), '[^a-z0-9]+'), lambda w: w IN {STYLE_HINTS}))) AS hints FROM p"""
)
def style_hints(spark, sf_dir):
    """The folder that names a file's site, and the known style words of its folders; the file's own name tells nothing."""
    site = F.get(F.split(F.get(F.split("url", "://"), F.lit(1)), "/"), F.lit(0))
    style = F.expr("CASE page_id % 4 WHEN 0 THEN 'Warm-Film' WHEN 1 THEN 'teal_ORANGE.moody' WHEN 2 THEN 'Faded/black  white' ELSE 'plain' END")
    path = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", F.lit("web"), site, style, F.lit("sepia.cube")).alias("path"))
    folders = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    known = F.array(*[F.lit(h) for h in STYLE_HINTS])
    return path.select("page_id", F.get(F.split("path", "/"), F.lit(1)).alias("domain"), F.sort_array(F.array_intersect(F.split(F.lower(folders), "[^a-z0-9]+"), known)).alias("hints"))


def instruction_text(raw: Column) -> Column:
    """The text of an instruction file: plain, or of a JSON object's first filled text field, else of its first string;
    of an array its first string.  What isn't JSON, or holds no string, is the file's own text; an empty file null."""
    kept = F.nullif(F.trim(raw), F.lit(""))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))

    def text_of(fields: Column) -> Column:
        named = [filled(F.try_variant_get(F.element_at(fields, k), "$", "string")) for k in TEXT_FIELDS]
        strings = F.filter(F.map_values(fields), lambda v: (F.schema_of_variant(v) == "STRING") & filled(F.try_variant_get(v, "$", "string")).isNotNull())
        return F.coalesce(*named, F.trim(F.try_variant_get(F.get(strings, F.lit(0)), "$", "string")))

    item = F.get(F.from_json(kept, "array<variant>"), F.lit(0))
    first = F.when(F.schema_of_variant(item) == "STRING", F.trim(F.try_variant_get(item, "$", "string")))
    return F.when(F.startswith(kept, F.lit("{")), F.coalesce(let(F.from_json(kept, "map<string,variant>"), text_of), kept)).when(F.startswith(kept, F.lit("[")), F.coalesce(first, kept)).otherwise(kept)


_FILES = """CASE p_partkey % 8 WHEN 0 THEN '{"id": 3, "prompt": " ' || p_name || ' ", "content": "later"}' WHEN 1 THEN '{"text": "", "user_want": "' || p_name || '"}' WHEN 2 THEN '{"n": 4, "zeta": "' || p_name || '", "alpha": "no"}'
    WHEN 3 THEN '["' || p_name || '", 2]' WHEN 4 THEN '  ' || p_name || '  ' WHEN 5 THEN '{broken' WHEN 6 THEN '{"n": 4}' ELSE '  ' END"""


@query("""SELECT p_partkey, CASE WHEN p_partkey % 8 < 5 THEN p_name WHEN p_partkey % 8 = 5 THEN '{broken' WHEN p_partkey % 8 = 6 THEN '{"n": 4}' END AS text FROM part""")
def text_field_pick(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", instruction_text(F.expr(_FILES)).alias("text"))


_NOTEBOOK = "array<struct<cell_type:string,outputs:array<struct<text:string,data:map<string,string>,output_type:string,ename:string,evalue:string,traceback:string>>>>"


def notebook_metric(content: Column) -> Column:
    """(status, metric, failures) of a notebook's JSON: what its code cells put out, the last metric line, failure signs."""
    joined = lambda c, by: F.coalesce(F.array_join(F.from_json(c, "array<string>"), by), c)
    cells = F.filter(F.from_json(content, f"cells {_NOTEBOOK}")["cells"], lambda c: c["cell_type"] == "code")
    outputs = F.flatten(F.transform(cells, lambda c: F.coalesce(c["outputs"], F.array())))

    def shown(o: Column) -> Column:
        failed = F.when(o["output_type"] == "error", F.concat(F.coalesce(joined(o["traceback"], "\n"), F.lit("")), F.lit("\n"), F.coalesce(o["ename"], F.lit("")), F.lit(": "), F.coalesce(o["evalue"], F.lit(""))))
        return F.concat_ws("\n", joined(o["text"], ""), joined(F.element_at(o["data"], "text/plain"), ""), failed)

    def read(text: Column) -> Column:
        metric = F.try_element_at(F.regexp_extract_all(text, F.lit(METRIC_LINE), 1), F.lit(-1)).cast("double")
        failures = F.filter(F.array(*[F.lit(f) for f in FAILURES]), lambda f: F.contains(text, f))
        return F.struct(F.when(metric.isNull(), "no_metric").when(F.size(failures) > 0, "failed").otherwise("ok").alias("status"), metric.alias("metric"), F.size(failures).alias("failures"))

    return let(F.coalesce(F.array_join(F.transform(outputs, shown), "\n"), F.lit("")), read)


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'ok' WHEN s_suppkey % 4 = 1 THEN 'failed' WHEN s_suppkey % 4 = 2 THEN 'no_metric' ELSE 'ok' END AS status,
    CASE s_suppkey % 4 WHEN 0 THEN s_suppkey / 8.0::DOUBLE WHEN 1 THEN s_suppkey::DOUBLE WHEN 3 THEN -0.25 END AS metric, (s_suppkey % 4 IN (1, 2))::INTEGER AS failures FROM supplier"""
)
def notebook_metrics(spark, sf_dir):
    """Notebooks with a metric in a list of lines, one that then fails, one that only fails, one with plain data."""
    head = '{"cells": [{"cell_type": "markdown", "source": "METRIC=9"}, {"cell_type": "code", "outputs": ['
    error = '{"output_type": "error", "ename": "E", "evalue": "x", "traceback": ["Traceback (most recent call last)", "at 1"]}'
    n = F.col("s_suppkey")
    body = (
        F.when(n % 4 == 0, F.concat(F.lit('{"text": ["METRIC=7\\n", "metric = '), (n / 8.0).cast("string"), F.lit('\\n"]}')))
        .when(n % 4 == 1, F.concat(F.lit('{"text": "METRIC='), n.cast("string"), F.lit('"}, ' + error))).when(n % 4 == 2, F.lit(error)).otherwise(F.lit('{"data": {"text/plain": "METRIC=-2.5e-1"}}'))
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", notebook_metric(F.concat(F.lit(head), body, F.lit("]}]}"))).alias("m")).select("s_suppkey", "m.*")


@query(
    f"""WITH {_DECISIONS} SELECT doc_id, CASE WHEN route = 'grade' AND refused THEN 'clarify' ELSE route END AS route, CASE WHEN route = 'refuse' THEN kind END AS refuse_reason, route = 'clarify' OR (route = 'grade' AND refused) AS asks,
    CASE WHEN route = 'grade' THEN 'route=grade | ' || lang END AS spec, CASE WHEN route = 'grade' AND NOT refused THEN '/runs/' || doc_id || '/output.cube' END AS cube_url, CASE WHEN route = 'grade' AND NOT refused THEN mixed END AS collapsed FROM r"""
)
def route_payloads(spark, sf_dir):
    """What a request gets: refusals a reason, unclear ones a question, others their table; where the generator refuses, a question."""
    route = F.col("route")
    made = (route == "grade") & ~F.col("refused")
    return decisions(spark, sf_dir).select(
        "doc_id", F.when((route == "grade") & F.col("refused"), "clarify").otherwise(route).alias("route"), F.when(route == "refuse", F.col("kind")).alias("refuse_reason"), ((route == "clarify") | ((route == "grade") & F.col("refused"))).alias("asks"),
        F.when(route == "grade", F.concat(F.lit("route=grade | "), "lang")).alias("spec"), F.when(made, F.concat(F.lit("/runs/"), F.col("doc_id").cast("string"), F.lit("/output.cube"))).alias("cube_url"), F.when(made, F.col("mixed")).alias("collapsed"),
    )


IGNORED = -100


def example(prompt: Column, target: Column, end: Column, most: int) -> Column:
    """(input_ids, labels): the target whole and closed by its end id, the prompt's tail in the room left, masked."""
    closed = F.when(F.try_element_at(target, F.lit(-1)).eqNullSafe(end), target).otherwise(F.concat(target, F.array(end)))

    def put(t: Column) -> Column:
        room = F.greatest(F.lit(0), F.least(F.lit(most) - F.size(t), F.size(prompt)))
        tail = F.slice(prompt, F.size(prompt) - room + 1, room)
        return F.struct(F.concat(tail, t).alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORED).cast("long"), room), t).alias("labels"))

    return let(closed, put)


@query(
    """WITH e AS (SELECT p_partkey, range(1, p_size + 1) AS prompt, list_concat(range(1000, 1000 + p_partkey % 19), CASE WHEN p_partkey % 3 = 0 AND p_partkey % 19 > 0 THEN [2::BIGINT] ELSE [] END) AS t FROM part),
    c AS (SELECT p_partkey, prompt, CASE WHEN len(t) > 0 AND t[-1] = 2 THEN t ELSE list_append(t, 2) END AS t FROM e), k AS (SELECT *, list_reverse(list_slice(list_reverse(prompt), 1, greatest(0, 16 - len(t)))) AS tail FROM c)
    SELECT p_partkey, list_concat(tail, t) AS input_ids, list_concat(list_transform(tail, lambda x: -100), t) AS labels FROM k"""
)
def assemble_examples(spark, sf_dir):
    n = F.col("p_partkey") % 19
    body = F.when(n > 0, F.sequence(F.lit(1000).cast("long"), 999 + n)).otherwise(F.array().cast("array<long>"))
    target = F.concat(body, F.when((F.col("p_partkey") % 3 == 0) & (n > 0), F.array(F.lit(2).cast("long"))).otherwise(F.array().cast("array<long>")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.sequence(F.lit(1).cast("long"), F.col("p_size").cast("long")).alias("prompt"), target.alias("target"))
    return rows.select("p_partkey", example(F.col("prompt"), F.col("target"), F.lit(2).cast("long"), 16).alias("e")).select("p_partkey", "e.*")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS fit_mean, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice END AS fit_p95, CASE WHEN l_partkey % 4 > 0 THEN l_discount END AS residual_xy_r2,
    CASE WHEN l_suppkey % 5 > 0 THEN l_tax END AS supported_cell_rate FROM lineitem"""
)
def flatten_metrics(spark, sf_dir):
    """Measurements held as structs become columns of the row; those of an absent struct are null."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("CASE WHEN l_linenumber % 3 > 0 THEN named_struct('mean', l_quantity, 'p95', l_extendedprice) END").alias("fit"),
        F.expr("CASE WHEN l_partkey % 4 > 0 THEN named_struct('xy_r2', l_discount) END").alias("spatial"), F.expr("CASE WHEN l_suppkey % 5 > 0 THEN named_struct('cells', l_tax) END").alias("support"),
    )
    return rows.select("l_orderkey", "l_linenumber", F.col("fit.mean").alias("fit_mean"), F.col("fit.p95").alias("fit_p95"), F.col("spatial.xy_r2").alias("residual_xy_r2"), F.col("support.cells").alias("supported_cell_rate"))


@query(f"WITH {_CACHE} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM k)")
def resume_any_status(spark, sf_dir):
    """Planned ids without any cached record, whatever its status."""
    return table(spark, sf_dir, "documents").select("doc_id").join(_cache(spark, sf_dir).select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


@query(f"{_ASSIGNED} SELECT doc_id, toxic, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM a WHERE split = 'train')")
def train_rows(spark, sf_dir):
    """Rows of the training split's ids: a semi join."""
    train = split_assignment(spark, sf_dir).where("split = 'train'").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality").join(train, "doc_id", "left_semi")


def strict_held_out(unit: Column, share: float) -> Column:
    """held_out of a unit that must be there; a row without one ends the job."""
    named = F.nullif(unit, F.lit(""))
    return held_out(F.coalesce(named, F.raise_error(F.lit("a row has no split unit")).cast("string")), share)


@query(f"{_ASSIGNED} SELECT doc_id, {sql_sha1_bucket('unit')} < 1000 AS holdout FROM a")
def strict_holdout(spark, sf_dir):
    return split_assignment(spark, sf_dir).select("doc_id", strict_held_out(F.col("unit"), 0.1).alias("holdout"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS place FROM supplier")
def sources_by_priority(spark, sf_dir):
    """Sources in order of priority, then id, numbered without gathering them."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return numbered(rows, ["s_nationkey", "s_suppkey"]).select("s_suppkey", F.col("n").alias("place"))


@query(
    """WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS tags, ['small', 'promo', 'widget', CASE WHEN p_size > 20 THEN 'cold' END] AS asked FROM part)
    SELECT p_partkey, list_sort(list_filter(tags, lambda x: list_contains(asked, x))) AS shared, len(list_filter(tags, lambda x: list_contains(asked, x))) > 0 AS any_shared FROM t"""
)
def tags_shared(spark, sf_dir):
    """The tags that a row and a request have in common."""
    tags = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    asked = F.array(F.lit("small"), F.lit("promo"), F.lit("widget"), F.when(F.col("p_size") > 20, "cold"))
    return table(spark, sf_dir, "part").select("p_partkey", F.sort_array(F.array_intersect(tags, asked)).alias("shared")).withColumn("any_shared", F.size("shared") > 0)


WARMUP, RATE = 500, 2e-5


@query(f"SELECT doc_id AS step, CASE WHEN doc_id < {WARMUP} THEN {RATE} * 1000000 * (doc_id + 1) / {WARMUP} ELSE {RATE} * 1000000 END::DOUBLE AS rate_ppm FROM documents")
def warmup_rates(spark, sf_dir):
    """A learning rate that rises in equal steps and then stays."""
    step = F.col("doc_id")
    rate = F.when(step < WARMUP, RATE * 1e6 * (step + 1) / WARMUP).otherwise(RATE * 1e6)
    return table(spark, sf_dir, "documents").select(step.alias("step"), rate.alias("rate_ppm"))
