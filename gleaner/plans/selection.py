"""Selection, plans and caps over documents, orders, parts and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.selection import numbered, quota_select
from ..operators.sharding import shard_files
from ..registry import query
from ..sources.tables import table

BUCKETS = ["en", "de", "fr"]  # spanish rows are in no listed bucket and so come last
CAPS = [("src0", 0.02), ("src1", 0.02), ("src2", 0.03), ("src6", 0.01)]
TARGET = 600
_CAPS = "caps(family, share) AS (VALUES " + ", ".join(f"('{f}', {s}::DOUBLE)" for f, s in CAPS) + ")"
_QUOTA = f"""WITH {_CAPS}, d AS (SELECT doc_id, source, lang, coalesce(nullif(list_position({BUCKETS}, lang), 0), {len(BUCKETS)}) AS b FROM documents),
z AS (SELECT least({TARGET}, count(*)) AS size FROM documents),
f AS (SELECT d.*, caps.share, row_number() OVER (PARTITION BY source ORDER BY b, doc_id) AS k FROM d LEFT JOIN caps ON caps.family = source),
o AS (SELECT f.*, row_number() OVER (ORDER BY b, doc_id) AS rank FROM f, z WHERE share IS NULL OR k <= floor(share * size))
"""


def _picked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("family"), F.col("lang").alias("bucket"), F.col("doc_id").alias("ord"))
    return quota_select(docs, spark.createDataFrame(CAPS, "family string, share double"), TARGET, BUCKETS)


@query(f"{_QUOTA} SELECT doc_id, source, rank::INTEGER AS rank FROM o, z WHERE rank <= size")
def quota_select_rows(spark, sf_dir):
    return _picked(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("family").alias("source"), "rank")


@query(f"{_QUOTA} SELECT lang AS bucket, count(*) AS picked, count(DISTINCT source) AS families FROM o, z WHERE rank <= size GROUP BY lang")
def bucket_report(spark, sf_dir):
    return _picked(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("picked"), F.countDistinct("family").alias("families"))


@query("SELECT max(n)::DOUBLE / sum(n) AS share, coalesce(max(n)::DOUBLE / sum(n) <= 0.5, TRUE) AS passes FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def dominance_check(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return by.agg(share.alias("share"), F.coalesce(share <= 0.5, F.lit(True)).alias("passes"))


_CRITERIA = """WITH a AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (text IS NULL OR text = '') AS blank, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs,
  count(*) FILTER (n_chars < 20) AS brief FROM documents),
m AS (SELECT max(k) AS top FROM (SELECT count(*) AS k FROM documents GROUP BY source)), l AS (SELECT count(*) AS labelled, avg(toxic) AS toxic FROM labels),
c AS (SELECT unnest([('rows', CASE WHEN n >= 1000 THEN 'pass' ELSE 'fail' END), ('unique_ids', CASE WHEN ids = n THEN 'pass' ELSE 'fail' END), ('no_blank', CASE WHEN blank = 0 THEN 'pass' ELSE 'fail' END),
  ('sources', CASE WHEN sources >= 10 THEN 'pass' ELSE 'fail' END), ('languages', CASE WHEN langs >= 4 THEN 'pass' ELSE 'fail' END), ('dominance', CASE WHEN n = 0 OR top <= 0.5 * n THEN 'pass' ELSE 'fail' END),
  ('brief', CASE WHEN brief <= 0.05 * n THEN 'pass' ELSE 'fail' END), ('labels', CASE WHEN labelled = 0 THEN 'pending' WHEN labelled >= 0.3 * n THEN 'pass' ELSE 'fail' END),
  ('toxicity', CASE WHEN labelled = 0 THEN 'pending' WHEN toxic <= 0.25 THEN 'pass' ELSE 'fail' END)]) AS c FROM a, m, l),
f AS (SELECT c[1] AS criterion, c[2] AS status FROM c)
SELECT criterion, status FROM f UNION ALL SELECT 'overall', CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'pending') THEN 'pending' ELSE 'pass' END FROM f"""


@query(_CRITERIA)
def acceptance_criteria(spark, sf_dir):
    """Nine criteria as rows and the overall status: any fail, then any pending, else pass."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    facts = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("blank"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.count_if(F.expr("n_chars < 20")).alias("brief"))
    top = docs.groupBy("source").agg(F.count("*").alias("k")).agg(F.max("k").alias("top"))
    facts = facts.crossJoin(top).crossJoin(labels.agg(F.count("*").alias("labelled"), F.avg("toxic").alias("toxic")))
    checks = {
        "rows": "n >= 1000", "unique_ids": "ids = n", "no_blank": "blank = 0", "sources": "sources >= 10", "languages": "langs >= 4",
        "dominance": "n = 0 OR top <= 0.5D * n", "brief": "brief <= 0.05D * n", "labels": "labelled >= 0.3D * n", "toxicity": "toxic <= 0.25D",
    }
    pending = {"labels", "toxicity"}
    rows = [F.struct(F.lit(name).alias("criterion"), F.expr(("CASE WHEN labelled = 0 THEN 'pending' " if name in pending else "CASE ") + f"WHEN {test} THEN 'pass' ELSE 'fail' END").alias("status")) for name, test in checks.items()]
    each = facts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    overall = each.agg(F.expr("CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'pending') THEN 'pending' ELSE 'pass' END").alias("status")).select(F.lit("overall").alias("criterion"), "status")
    return each.unionByName(overall)


# Fixed value: the most warm-up pairs.
MOST_PAIRS = 100_000
_WARM = f"""WITH l AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), t AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS j, count(*) OVER () AS items FROM benchmark WHERE length(text) >= 150),
x AS (SELECT p_partkey, p_brand, item_id FROM l, t WHERE i * items + j < {MOST_PAIRS})"""


@query(f"{_WARM} SELECT p_partkey, item_id FROM x")
def warmup_pairs(spark, sf_dir):
    return _warm(spark, sf_dir).select("p_partkey", "item_id")


def _warm(spark, sf_dir, most: int = MOST_PAIRS):
    """Parts in order, each with all benchmark items that are not reserved (short ones are), up to `most` pairs in all.

    The pairs are numbered, and a number gives the part and the item that it joins, so nothing is multiplied out and cut.
    """
    items = numbered(table(spark, sf_dir, "benchmark").where("length(text) >= 150").select("item_id"), ["item_id"]).withColumnRenamed("n", "j")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    many, all_parts = items.count(), parts.count()
    first = parts.orderBy("p_partkey").limit(-(-most // max(1, many)))
    pairs = spark.range(min(most, many * all_parts)).select(F.expr(f"id div {max(1, many)}").alias("n"), F.expr(f"id % {max(1, many)}").alias("j"))
    return pairs.join(numbered(first, ["p_partkey"]), "n").join(items, "j")


@query(f"{_WARM} SELECT p_brand, count(*) AS pairs FROM x GROUP BY p_brand")
def warmup_per_family(spark, sf_dir):
    return _warm(spark, sf_dir).groupBy("p_brand").agg(F.count("*").alias("pairs"))


_FALLBACK = """WITH c AS (SELECT o_custkey AS pack, o_orderpriority AS connector, o_orderkey, left(o_orderpriority, 1)::INTEGER AS ordinal, o_orderstatus <> 'F' AS enabled FROM orders),
a AS (SELECT pack, ordinal, count(*) AS acquired FROM c WHERE enabled GROUP BY ALL), f AS (SELECT pack, min(ordinal) AS ordinal FROM a GROUP BY pack)
SELECT a.pack, a.ordinal, least(a.acquired, 5)::BIGINT AS acquired FROM a JOIN f USING (pack, ordinal)"""


@query(_FALLBACK)
def fallback_source_pick(spark, sf_dir):
    """Per pack, the first enabled connector that acquires anything, at most five artefacts."""
    got = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("pack"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("ordinal")).agg(F.count("*").alias("n"))
    return got.groupBy("pack").agg(F.min(F.struct("ordinal", "n")).alias("f")).select("pack", "f.ordinal", F.least("f.n", F.lit(5)).cast("long").alias("acquired"))


@query("WITH l AS (SELECT o_custkey, max((o_orderdate, o_orderkey)) AS m FROM orders GROUP BY o_custkey) SELECT o_custkey, m[2] AS o_orderkey FROM l ORDER BY m[1] DESC, m[2] DESC LIMIT 50")
def newest_cap(spark, sf_dir):
    """The newest entry of each id, then the fifty newest ids."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return last.orderBy(F.desc("m.o_orderdate"), F.desc("m.o_orderkey")).limit(50).select("o_custkey", "m.o_orderkey")


@query()
def shard_plan(spark, sf_dir):
    """Each customer's orders as files in key order, in shards of a million bytes (price as bytes)."""
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("name"), F.col("o_totalprice").cast("long").alias("bytes"))
    return shard_files(files, 1_000_000)


_ROUND = ["local_region_edit", "geometry", "inpainting", "hue_rotation", "underspecified_intent"]


@query(f"WITH r AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS n FROM pages) SELECT page_id, ({_ROUND})[(n % 5)::INTEGER + 1] AS category FROM r")
def round_robin_plan(spark, sf_dir):
    rows = numbered(table(spark, sf_dir, "pages").select("page_id"), ["page_id"])
    return rows.select("page_id", F.element_at(F.lit(_ROUND), (F.col("n") % 5 + 1).cast("int")).alias("category"))


_PAIRED = """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE n_chars > 400),
i AS (SELECT page_id, row_number() OVER (ORDER BY sha256('7:' || page_id), page_id) AS k FROM pages)
SELECT doc_id, page_id FROM n JOIN i USING (k)"""


@query(_PAIRED)
def positional_pairing(spark, sf_dir):
    """The n-th document that needs a page gets the n-th page of a hash-shuffled list."""
    need = numbered(table(spark, sf_dir, "documents").where("n_chars > 400").select("doc_id"), ["doc_id"])
    free = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.concat(F.lit("7:"), F.col("page_id").cast("string")), 256).alias("h"))
    return need.join(numbered(free, ["h", "page_id"]), "n").select("doc_id", "page_id")
