"""Registry rows, inventories and page scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.splits import first_named
from ..operators.validation import ACCESS, registry_errors, removal_scope
from ..registry import query
from ..sources.tables import table

_REGISTRY = """g AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 13 = 0 THEN '' ELSE o_orderpriority END AS source_family, CASE WHEN o_custkey % 17 <> 0 THEN 'pack' || o_custkey % 5 END AS source_pack_id, md5(o_orderkey::VARCHAR) AS file_hash,
  CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'srgb' END AS canonical_domain_id, CASE o_orderkey % 7 WHEN 0 THEN 'bronze' WHEN 1 THEN 'rejected' WHEN 2 THEN NULL ELSE 'gold' END AS representability_tier FROM orders)"""


def _registry(spark, sf_dir) -> DataFrame:
    """Orders as registry rows, some of them faulty."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_custkey % 13 = 0 THEN '' ELSE o_orderpriority END").alias("source_family"), F.expr("CASE WHEN o_custkey % 17 <> 0 THEN concat('pack', cast(o_custkey % 5 AS string)) END").alias("source_pack_id"),
        F.md5(F.col("o_orderkey").cast("string")).alias("file_hash"), F.expr("CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'srgb' END").alias("canonical_domain_id"),
        F.expr("CASE o_orderkey % 7 WHEN 0 THEN 'bronze' WHEN 1 THEN 'rejected' WHEN 2 THEN NULL ELSE 'gold' END").alias("representability_tier"),
    )


@query(
    f"""WITH {_REGISTRY} SELECT id, concat_ws('|', CASE WHEN coalesce(source_family, '') = '' THEN 'missing_source_family' END, CASE WHEN coalesce(source_pack_id, '') = '' THEN 'missing_source_pack_id' END, CASE WHEN coalesce(file_hash, '') = '' THEN 'missing_file_hash' END,
    CASE WHEN coalesce(canonical_domain_id, '') = '' THEN 'missing_canonical_domain_id' END, CASE WHEN coalesce(representability_tier, '') NOT IN ('', 'gold', 'diagnostic_only', 'rejected') THEN 'bad_tier' END) AS errors FROM g"""
)
def registry_validate(spark, sf_dir):
    return _registry(spark, sf_dir).select("id", F.array_join(registry_errors(), "|").alias("errors"))


@query(f"WITH {_REGISTRY} SELECT id, coalesce(nullif(source_pack_id, ''), nullif(canonical_domain_id, ''), nullif(source_family, ''), file_hash) AS key FROM g")
def key_precedence(spark, sf_dir):
    """The first key that is neither null nor empty."""
    return _registry(spark, sf_dir).select("id", first_named(F.col("source_pack_id"), F.col("canonical_domain_id"), F.col("source_family"), F.col("file_hash")).alias("key"))


@query("SELECT coalesce(bool_or(o_orderstatus = 'F'), FALSE) AS used_for_training, coalesce(bool_or(o_totalprice > 400000), FALSE) AS used_for_eval, array_to_string(list_sort(list(DISTINCT md5((o_custkey % 40)::VARCHAR))), '|') AS hashes, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'")
def removal_scope_report(spark, sf_dir):
    """Forty packs stand for a family's files, so the list of hashes is that long at most."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), F.expr("o_orderstatus = 'F'").alias("used_for_training"), F.expr("o_totalprice > 400000").alias("used_for_eval"), F.md5((F.col("o_custkey") % 40).cast("string")).alias("h"))
    return removal_scope(rows, "1-URGENT", ["used_for_training", "used_for_eval"], "h").withColumn("hashes", F.array_join("hashes", "|"))


_INVENTORY = "i AS (SELECT s_suppkey % 900 AS id, ['download', 'api', 'local', 'generated', 'magic'][s_nationkey % 5 + 1] AS access, s_nationkey AS family FROM supplier)"


@query(
    f"WITH {_INVENTORY}, d AS (SELECT id, count(*) AS k FROM i GROUP BY id) SELECT i.id, i.family, concat_ws('|', CASE WHEN k > 1 THEN 'duplicate_id' END, CASE WHEN access NOT IN {ACCESS} THEN 'bad_access_method' END, CASE WHEN n_regionkey = 4 THEN 'excluded_family' END) AS errors FROM i JOIN d USING (id) JOIN nation ON n_nationkey = family"
)
def inventory_validate(spark, sf_dir):
    """Repeated ids, unknown access methods and excluded families."""
    access = F.element_at(F.array(*[F.lit(a) for a in (*ACCESS, "magic")]), (F.col("s_nationkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 900).alias("id"), access.alias("access"), F.col("s_nationkey").alias("family"))
    often = rows.groupBy("id").agg(F.count("*").alias("k"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("family"), "n_regionkey")
    errors = F.concat_ws("|", F.when(F.col("k") > 1, "duplicate_id"), F.when(~F.col("access").isin(*ACCESS), "bad_access_method"), F.when(F.col("n_regionkey") == 4, "excluded_family"))
    return rows.join(often, "id").join(nation, "family").select("id", "family", errors.alias("errors"))


@query("""SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|img)[^>]*?\\s(?:href|src)\\s*=\\s*["'']([^"'']+)["'']', 1)) AS link FROM pages) WHERE link <> ''""")
def html_links(spark, sf_dir):
    """Distinct link and image targets of each page."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)<(?:a|img)[^>]*?\s(?:href|src)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(links)).alias("link")).where("link <> ''")


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '') AS heading, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?i)(CC[ -]BY[A-Za-z0-9 .-]*|MIT License|Apache License)', 1), '') AS license FROM pages")
def html_title_license(spark, sf_dir):
    pick = lambda p: F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", pick(r"(?is)<h1[^>]*>(.*?)</h1>").alias("heading"), pick(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), F.nullif(F.regexp_extract("html", r"(?i)(CC[ -]BY[A-Za-z0-9 .-]*|MIT License|Apache License)", 1), F.lit("")).alias("license"))


_STEM = "regexp_replace(regexp_replace(lower(url), '[?#].*$', '', 'g'), '(\\.html|/)$', '', 'g')"


@query(
    f"""WITH s AS (SELECT page_id, regexp_extract({_STEM}, '([^/]+)$', 1) AS stem, regexp_matches(url, '[?#]') AS expert FROM pages), f AS (SELECT stem, expert, min(page_id) AS page_id FROM s WHERE stem <> '' GROUP BY ALL)
    SELECT a.stem, a.page_id AS source_id, b.page_id AS expert_id FROM f a JOIN f b ON a.stem = b.stem AND NOT a.expert AND b.expert"""
)
def url_stem_pairs(spark, sf_dir):
    """Plain and decorated urls of one stem, the first of each: one grouping, no join."""
    stem = F.regexp_extract(F.regexp_replace(F.regexp_replace(F.lower("url"), r"[?#].*$", ""), r"(\.html|/)$", ""), r"([^/]+)$", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", stem.alias("stem"), F.regexp_like("url", F.lit("[?#]")).alias("expert")).where("stem <> ''")
    both = rows.groupBy("stem").agg(F.min(F.expr("CASE WHEN NOT expert THEN page_id END")).alias("source_id"), F.min(F.expr("CASE WHEN expert THEN page_id END")).alias("expert_id"))
    return both.where("source_id IS NOT NULL AND expert_id IS NOT NULL")


@query("SELECT page_id, regexp_extract(url, '(/(en|de|fr|es)/.*)$', 1) AS path FROM pages")
def portable_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"(/(en|de|fr|es)/.*)$", 1).alias("path"))


@query("WITH c AS (SELECT o_custkey AS pack, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'P') SELECT pack, o_orderkey FROM c WHERE k <= 3")
def connector_caps(spark, sf_dir):
    """Enabled artefacts in listing order, three of each pack."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("pack"), "o_orderkey", k.alias("k")).where("k <= 3").select("pack", "o_orderkey")


@query("WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), f AS (SELECT h, min(doc_id) AS doc_id FROM h WHERE h NOT IN (SELECT sha256(text) FROM benchmark WHERE text IS NOT NULL) GROUP BY h) SELECT doc_id, h FROM f")
def new_content_only(spark, sf_dir):
    """The first of each content that the store does not hold yet."""
    held = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.sha2("text", 256).alias("h"))
    first = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return first.join(held, "h", "left_anti").select("doc_id", "h")


@query("SELECT o_orderpriority AS source, count(*) AS attempted, count(*) FILTER (o_orderstatus = 'O') AS acquired, CASE WHEN count(*) FILTER (o_orderstatus = 'O') = 0 THEN 'failed' WHEN count(*) FILTER (o_orderstatus = 'O') = count(*) THEN 'ok' ELSE 'partial' END AS status FROM orders GROUP BY 1")
def stage_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("attempted"), F.count_if(F.expr("o_orderstatus = 'O'")).alias("acquired"))
    return rows.withColumn("status", F.expr("CASE WHEN acquired = 0 THEN 'failed' WHEN acquired = attempted THEN 'ok' ELSE 'partial' END"))


@query("SELECT doc_id, regexp_extract(text, '(\\d{4,})', 1) AS first_number, regexp_matches(text, '(?i)licensed under') AS licensed FROM documents")
def header_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"(\d{4,})", 1).alias("first_number"), F.regexp_like("text", F.lit("(?i)licensed under")).alias("licensed"))
