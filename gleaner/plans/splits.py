"""Split units, splits and holdouts over documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import held_out, sql_sha1_bucket, sql_split
from ..operators.components import components
from ..operators.similarity import jaccard_edges
from ..operators.splits import assign, dev_holdout, units
from ..registry import query
from ..sources.tables import table

_UNITS = """u AS (SELECT text, 'unit_' || substr(sha256(string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id::VARCHAR)), 1, 16) AS unit, count(*) AS size
  FROM documents GROUP BY text)"""
_ASSIGNED = f"WITH {_UNITS}, a AS (SELECT d.doc_id, u.unit, {sql_split('u.unit')} AS split FROM documents d JOIN u ON d.text IS NOT DISTINCT FROM u.text)"


def _rows(spark, sf_dir):
    """Equal texts share a group; the digest of a text stands for it in the shuffle."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id"), F.sha2(F.col("text"), 256).alias("group"))


@query(f"WITH {_UNITS} SELECT unit, size FROM u")
def split_units_exact(spark, sf_dir):
    return units(_rows(spark, sf_dir), "group", "doc_id").select("unit", "size")


@query(f"{_ASSIGNED} SELECT doc_id, unit, split FROM a")
def split_assignment(spark, sf_dir):
    return assign(_rows(spark, sf_dir), "group", "doc_id")


@query(f"{_ASSIGNED} SELECT split, count(*) AS n_rows, count(DISTINCT unit) AS n_units FROM a GROUP BY split")
def split_counts(spark, sf_dir):
    return split_assignment(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("unit").alias("n_units"))


@query(f"{_ASSIGNED}, r AS (SELECT doc_id, unit, split FROM a) SELECT doc_id, CASE WHEN bool_or(source = 'src0') OVER (PARTITION BY unit) THEN 'train' ELSE split END AS split FROM r JOIN documents USING (doc_id)")
def split_forced_train(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("group"), "source")
    return assign(docs, "group", "doc_id", forced=F.col("source") == "src0").select("doc_id", "split")


@query(f"{_ASSIGNED} SELECT sha256(string_agg(doc_id || ':' || split, '|' ORDER BY doc_id::VARCHAR)) AS split_id FROM a")
def split_id(spark, sf_dir):
    """Two levels: digests of sorted ranges are not the published form, so the sorted list of short strings is one group by contract."""
    rows = split_assignment(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "split")
    return rows.agg(F.sort_array(F.collect_list(F.struct("id", "split"))).alias("m")).select(F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["id"], F.lit(":"), x["split"])), "|"), 256).alias("split_id"))


@query("SELECT sha256(string_agg(h, '' ORDER BY h)) AS corpus_id FROM (SELECT DISTINCT sha256(text) AS h FROM documents)")
def corpus_id(spark, sf_dir):
    hashes = table(spark, sf_dir, "documents").select(F.sha2(F.col("text"), 256).alias("h")).distinct()
    return hashes.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("corpus_id"))


@query(f"{_ASSIGNED} SELECT doc_id, unit, {sql_sha1_bucket('unit')} < 500 AS holdout FROM a")
def holdout_rows(spark, sf_dir):
    return split_assignment(spark, sf_dir).select("doc_id", "unit", held_out(F.col("unit"), 0.05).alias("holdout"))


@query(
    f"""{_ASSIGNED}, h AS (SELECT unit, {sql_sha1_bucket('doc_id::VARCHAR')} < 500 AS by_row, {sql_sha1_bucket('unit')} < 500 AS by_unit FROM a),
    g AS (SELECT unit, bool_or(by_row) AND bool_or(NOT by_row) AS row_crosses, bool_or(by_unit) AND bool_or(NOT by_unit) AS unit_crosses FROM h GROUP BY unit)
    SELECT count(*) AS units, count(*) FILTER (row_crosses) AS crossing_by_row, count(*) FILTER (unit_crosses) AS crossing_by_unit FROM g"""
)
def holdout_leak_check(spark, sf_dir):
    """How many units a holdout keyed by rows tears apart, and one keyed by units (none)."""
    rows = split_assignment(spark, sf_dir).select("unit", held_out(F.col("doc_id").cast("string"), 0.05).alias("r"), held_out(F.col("unit"), 0.05).alias("u"))
    by = rows.groupBy("unit").agg((F.bool_or("r") & F.bool_or(~F.col("r"))).alias("row_crosses"), (F.bool_or("u") & F.bool_or(~F.col("u"))).alias("unit_crosses"))
    return by.agg(F.count("*").alias("units"), F.count_if("row_crosses").alias("crossing_by_row"), F.count_if("unit_crosses").alias("crossing_by_unit"))


@query(
    f"""WITH r AS (SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS n,
      row_number() OVER (PARTITION BY p_brand ORDER BY {sql_sha1_bucket('p_partkey::VARCHAR')}, p_partkey) AS k FROM part)
    SELECT p_partkey, p_brand, n > 1 AND k <= least(n - 1, greatest(1, round_even(n * 0.1, 0)::BIGINT)) AS dev FROM r"""
)
def dev_holdout_stratified(spark, sf_dir):
    return dev_holdout(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand")


_GRAMS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(t) < 3 THEN t ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS gram FROM g), n AS (SELECT doc_id, len(s) AS n FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b, k / (x.n + y.n - k)::DOUBLE AS jaccard FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k))"""


@query(
    f"""WITH RECURSIVE {_GRAMS}, l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.other),
    root AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
    u AS (SELECT root, 'unit_' || substr(sha256(string_agg(id::VARCHAR, '|' ORDER BY id::VARCHAR)), 1, 16) AS unit, count(*) AS size FROM root GROUP BY root)
    SELECT root.id AS doc_id, u.unit, u.size, {sql_split('u.unit')} AS split FROM root JOIN u USING (root)"""
)
def components_units(spark, sf_dir):
    """Units are the components of near copies; each unit falls in one split."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    roots = components(docs, jaccard_edges(docs, 3, 0.8))
    named = units(roots, "root", "id")
    split = assign(roots, "root", "id").select("id", "split")
    return roots.join(named, "root").join(split, "id").select(F.col("id").alias("doc_id"), "unit", "size", "split")
