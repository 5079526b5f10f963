"""Joins that assemble training and evaluation rows; documents, parts, orders and turns stand in for the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import split_of, sql_split
from ..functions.text import caption_issue
from ..operators.selection import numbered
from ..registry import query
from ..sources.tables import table
from .selection import _QUOTA, _picked

#: a tier for each part, by its key; accepted ones are gold and diagnostic_only
_TIER = "CASE WHEN p_partkey % 10 < 3 THEN 'gold' WHEN p_partkey % 10 < 7 THEN 'diagnostic_only' ELSE 'rejected' END"
_FALSY = "CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN NULL ELSE 'r' || (p_partkey // 2) END"


def first_of(*names: str):
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


@query(
    f"""WITH p AS (SELECT p_partkey, {_TIER} AS tier, {_FALSY} AS residual_key, CASE WHEN p_size % 3 = 0 THEN 'lut' || p_size END AS lut_id, md5(p_name) AS file_hash FROM part)
    SELECT p_partkey, tier, coalesce(nullif(residual_key, ''), nullif(lut_id, ''), file_hash) AS key FROM p WHERE tier IN ('gold', 'diagnostic_only')"""
)
def accepted_candidates(spark, sf_dir):
    """Rows of an accepted tier with the key of their residual."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(n % 10 < 3, "gold").when(n % 10 < 7, "diagnostic_only").otherwise("rejected").alias("tier"),
        F.when(n % 4 == 0, "").when(n % 4 != 1, F.concat(F.lit("r"), F.floor(n / 2).cast("string"))).alias("residual_key"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("lut"), F.col("p_size").cast("string"))).alias("lut_id"), F.md5("p_name").alias("file_hash"),
    )
    return rows.where(F.col("tier").isin("gold", "diagnostic_only")).select("p_partkey", "tier", first_of("residual_key", "lut_id", "file_hash").alias("key"))


@query(
    f"""{_QUOTA}, s AS (SELECT doc_id, rank FROM o, z WHERE rank <= size), u AS (SELECT doc_id, {sql_split('source')} AS split FROM documents)
    SELECT s.rank::INTEGER AS rank, s.doc_id, d.source, d.lang, d.n_chars, u.split FROM s JOIN documents d USING (doc_id) JOIN u USING (doc_id)"""
)
def selected_full_rows(spark, sf_dir):
    """Selected ids with their place in the selection, joined to the whole rows and their split."""
    chosen = _picked(spark, sf_dir).select(F.col("id").alias("doc_id"), "rank")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", split_of(F.col("source")).alias("split"))
    return chosen.join(docs, "doc_id").select("rank", "doc_id", "source", "lang", "n_chars", "split")


_TARGETS = """r AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS supported, o_orderkey % 9 = 0 AS done, 'f' || o_custkey AS file_hash FROM orders),
k AS (SELECT 'f' || c_custkey AS file_hash, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_nationkey END, 'f' || c_custkey) AS key FROM customer WHERE c_acctbal > 0),
t AS (SELECT 'n' || n_nationkey AS key, n_nationkey * 1.0 AS tensor FROM nation UNION ALL SELECT 'f' || s_suppkey, s_acctbal FROM supplier),
m AS (SELECT id, CASE WHEN NOT supported THEN 'unsupported' WHEN done THEN 'already' WHEN k.key IS NULL THEN 'no_key' WHEN t.key IS NULL THEN 'no_tensor' ELSE 'resolved' END AS reason, t.tensor FROM r LEFT JOIN k USING (file_hash) LEFT JOIN t ON t.key = k.key)"""


def targets(spark, sf_dir) -> DataFrame:
    """(id, reason, tensor): file hash -> residual key -> tensor in two hops, with what became of each row."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("supported"), (F.col("o_orderkey") % 9 == 0).alias("done"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file_hash"))
    named = F.concat(F.lit("f"), F.col("c_custkey").cast("string"))
    keys = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(named.alias("file_hash"), F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), named).alias("key"))
    tensors = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").cast("double").alias("tensor"))
    tensors = tensors.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_acctbal").alias("tensor")))
    met = rows.join(keys, "file_hash", "left").join(tensors.withColumn("there", F.lit(True)), "key", "left")
    reason = F.when(~F.col("supported"), "unsupported").when(F.col("done"), "already").when(F.col("key").isNull(), "no_key").when(F.col("there").isNull(), "no_tensor").otherwise("resolved")
    return met.select("id", reason.alias("reason"), "tensor")


@query(f"WITH {_TARGETS} SELECT id, reason, CASE WHEN reason = 'resolved' THEN tensor END AS tensor FROM m")
def materialize_targets(spark, sf_dir):
    return targets(spark, sf_dir).withColumn("tensor", F.when(F.col("reason") == "resolved", F.col("tensor")))


@query(f"WITH {_TARGETS} SELECT reason, count(*) AS n FROM m GROUP BY reason")
def materialize_report(spark, sf_dir):
    return targets(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT coalesce(CASE WHEN p_partkey % 2 = 0 THEN 'src' || p_partkey END, 'id' || p_partkey) AS key, CASE WHEN p_size > 5 THEN 'unit' || p_size END AS unit FROM part WHERE p_retailprice > 950),
    k AS (SELECT key, unit FROM l WHERE unit IS NOT NULL), c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'src' || l_partkey ELSE 'id' || l_partkey END AS key FROM lineitem)
    SELECT coalesce(unit, '(missing unit)') AS unit, count(*) AS captions FROM c LEFT JOIN k USING (key) GROUP BY ALL"""
)
def caption_units(spark, sf_dir):
    """Captions by the unit of their table; those without one are counted, not lost silently."""
    name = lambda n: F.when(F.col(n) % 2 == 0, F.concat(F.lit("src"), F.col(n).cast("string"))).otherwise(F.concat(F.lit("id"), F.col(n).cast("string")))
    units = table(spark, sf_dir, "part").where("p_retailprice > 950 AND p_size > 5").select(name("p_partkey").alias("key"), F.concat(F.lit("unit"), F.col("p_size").cast("string")).alias("unit"))
    captions = table(spark, sf_dir, "lineitem").select(name("l_partkey").alias("key"))
    return captions.join(units, "key", "left").groupBy(F.coalesce("unit", F.lit("(missing unit)")).alias("unit")).agg(F.count("*").alias("captions"))


@query(
    """WITH o AS (SELECT user_id AS row_id, arg_max(event_type, event_id) AS kind, max(event_id) AS last_event FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
    SELECT c_custkey, coalesce(kind, 'missing') AS kind, coalesce(last_event, -1) AS last_event FROM customer LEFT JOIN o ON row_id = c_custkey"""
)
def eval_rows_outputs(spark, sf_dir):
    """Every evaluation row with its last output; rows without one stay."""
    last = table(spark, sf_dir, "events").where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", "event_id").alias("kind"), F.max("event_id").alias("last_event"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("kind", F.lit("missing")).alias("kind"), F.coalesce("last_event", F.lit(-1)).alias("last_event"))


_POOL = """r AS (SELECT doc_id, toxic = 0 AS supported, quality, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'clarify' ELSE 'refuse' END AS route, coalesce(n_chars, 0) > 0 AND text <> '' AS has_text, doc_id % 7 = 0 AS holdout FROM documents JOIN labels USING (doc_id)),
p AS (SELECT doc_id, TRUE AS supported FROM r WHERE supported AND quality = 1 AND NOT holdout UNION ALL SELECT doc_id, FALSE FROM r WHERE NOT supported AND has_text AND coalesce(route, '') <> 'clarify')"""


def pool(spark, sf_dir) -> DataFrame:
    """Supported rows outside the holdout, and refusals with text whose route isn't clarify (no route passes)."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    route = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, "clarify").otherwise("refuse")
    rows = rows.select("doc_id", (F.col("toxic") == 0).alias("supported"), "quality", route.alias("route"), F.expr("coalesce(n_chars, 0) > 0 AND text <> ''").alias("has_text"), (F.col("doc_id") % 7 == 0).alias("holdout"))
    return rows.where("CASE WHEN supported THEN quality = 1 AND NOT holdout ELSE has_text AND NOT route <=> 'clarify' END").select("doc_id", "supported")


@query(f"WITH {_POOL} SELECT doc_id, supported FROM p")
def training_pool(spark, sf_dir):
    return pool(spark, sf_dir)


@query(
    f"""WITH {_POOL}, n AS (SELECT doc_id, supported, row_number() OVER (PARTITION BY supported ORDER BY doc_id) AS k FROM p), u AS (SELECT CASE WHEN count(*) FILTER (NOT supported) > 0 THEN 9 ELSE 0 END AS u FROM p)
    SELECT doc_id, supported FROM n, u WHERE k <= CASE WHEN supported THEN 60 - u ELSE u END"""
)
def balanced_smoke_pool(spark, sf_dir):
    """Sixty rows of the pool, 15 % of them refusals while there are any: two top lists."""
    rows = pool(spark, sf_dir)
    refusals = rows.where("NOT supported").orderBy("doc_id").limit(9)
    some = refusals.agg(F.when(F.count("*") > 0, 9).otherwise(0).alias("u"))
    kept = rows.where("supported").orderBy("doc_id").limit(60)
    return numbered(kept, ["doc_id"]).crossJoin(F.broadcast(some)).where("n < 60 - u").select("doc_id", "supported").unionByName(refusals)


@query(
    """WITH c AS (SELECT conv_id, min(CASE WHEN conv_id % 6 = 0 THEN 'failed' ELSE 'generated' END) AS status FROM conversations GROUP BY conv_id)
    SELECT 'cap_' || conv_id || '_' || role || turn AS id, conv_id AS source, role AS style, text AS caption FROM conversations JOIN c USING (conv_id) WHERE status = 'generated' AND text IS NOT NULL AND length(trim(text)) BETWEEN 6 AND 400"""
)
def caption_flatten(spark, sf_dir):
    """Sets of captions (a map by style) flattened to a row per valid caption of a generated set."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.struct(F.concat("role", F.col("turn").cast("string")).alias("name"), "role", "text").alias("c"))
    sets = turns.groupBy("conv_id").agg(F.collect_list("c").alias("captions"), F.when(F.col("conv_id") % 6 == 0, "failed").otherwise("generated").alias("status"))
    rows = sets.where("status = 'generated'").select("conv_id", F.explode("captions").alias("c"))
    valid = rows.where(caption_issue(F.col("c.text")).isNull())
    return valid.select(F.concat(F.lit("cap_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("c.name")).alias("id"), F.col("conv_id").alias("source"), F.col("c.role").alias("style"), F.col("c.text").alias("caption"))


@query(
    """WITH a AS (SELECT CASE WHEN doc_id % 8 = 0 THEN 'unsup_train_' || doc_id ELSE 'doc_' || doc_id END AS id, source FROM documents), n AS (SELECT 'unsup_train_' || lpad(page_id::VARCHAR, 6, '0') AS id, 'pages' AS source FROM pages WHERE page_id % 3 = 0)
    SELECT id, source FROM a WHERE NOT starts_with(id, 'unsup_') UNION ALL SELECT id, source FROM n"""
)
def replace_by_prefix(spark, sf_dir):
    """A merge that can be repeated: rows of the prefix go, the new ones come."""
    n = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("unsup_train_"), n)).otherwise(F.concat(F.lit("doc_"), n)).alias("id"), "source")
    new = table(spark, sf_dir, "pages").where("page_id % 3 = 0").select(F.concat(F.lit("unsup_train_"), F.lpad(F.col("page_id").cast("string"), 6, "0")).alias("id"), F.lit("pages").alias("source"))
    return rows.where(~F.startswith("id", F.lit("unsup_"))).unionByName(new)


@query(
    """WITH s AS (SELECT page_id, source, slug FROM (SELECT page_id, page_id % 4 AS source, regexp_replace(lower(split_part(split_part(url, '://', 2), '/', 1)), '[^a-z0-9]+', '-', 'g') AS slug FROM pages WHERE url IS NOT NULL))
    SELECT source, slug, min(page_id) AS page_id, count(*) - 1 AS skipped FROM s GROUP BY ALL"""
)
def slug_dedup(spark, sf_dir):
    """Within a run, the first page of each slug; the others are counted as skipped."""
    host = F.lower(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", (F.col("page_id") % 4).alias("source"), F.regexp_replace(host, "[^a-z0-9]+", "-").alias("slug"))
    return rows.groupBy("source", "slug").agg(F.min("page_id").alias("page_id"), (F.count("*") - 1).alias("skipped"))


@query(
    """SELECT 'page_' || page_id AS lut_id, 'scraped_web' AS source_family, url AS source_url, coalesce(strlen(html), 0)::BIGINT AS size_bytes, md5(coalesce(html, '')) AS file_hash, CASE WHEN html IS NULL OR html = '' THEN 'download_failed' ELSE 'acquired' END AS status,
    list_filter([CASE WHEN url IS NULL THEN 'missing_url' END, CASE WHEN html IS NULL OR html = '' THEN 'empty_artifact' END], lambda x: x IS NOT NULL) AS warnings FROM pages"""
)
def artifact_rows(spark, sf_dir):
    """Downloaded artefacts as registry rows."""
    empty = F.coalesce("html", F.lit("")) == ""
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("lut_id"), F.lit("scraped_web").alias("source_family"), F.col("url").alias("source_url"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size_bytes"),
        F.md5(F.coalesce("html", F.lit(""))).alias("file_hash"), F.when(empty, "download_failed").otherwise("acquired").alias("status"),
        F.array_compact(F.array(F.when(F.col("url").isNull(), "missing_url"), F.when(empty, "empty_artifact"))).alias("warnings"),
    )
