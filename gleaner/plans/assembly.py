"""Corpus assembly: unions, keyed joins, resumable caches and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sharding import content_key, reconcile
from ..registry import query
from ..sources.tables import table


@query(
    """SELECT 'doc_' || doc_id AS id, text, CASE WHEN toxic = 1 THEN 'refuse' ELSE 'grade' END AS route, source AS family FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT 'turn_' || conv_id || '_' || turn, text, 'clarify', NULL FROM conversations WHERE role = 'user' UNION ALL SELECT 'item_' || item_id, text, 'grade', NULL FROM benchmark"""
)
def corpus_union(spark, sf_dir):
    return _corpus(spark, sf_dir)


def _corpus(spark, sf_dir) -> DataFrame:
    """Three sources in one schema; columns that a source lacks are null."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    docs = docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "text", F.when(F.col("toxic") == 1, "refuse").otherwise("grade").alias("route"), F.col("source").alias("family"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("_", F.lit("turn"), "conv_id", "turn").alias("id"), "text", F.lit("clarify").alias("route"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("id"), "text", F.lit("grade").alias("route"))
    return docs.unionByName(turns, allowMissingColumns=True).unionByName(items, allowMissingColumns=True)


@query(
    """WITH c AS (SELECT text, CASE WHEN toxic = 1 THEN 'refuse' ELSE 'grade' END AS route FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT text, 'clarify' FROM conversations WHERE role = 'user' UNION ALL SELECT text, 'grade' FROM benchmark) SELECT route, count(*) AS n, count(DISTINCT md5(text)) AS units FROM c GROUP BY route"""
)
def corpus_stats(spark, sf_dir):
    return _corpus(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"), F.countDistinct(F.md5("text")).alias("units"))


#: even turns of a conversation stand in for cached results; the role tells their status
_CACHE = "k AS (SELECT conv_id AS id, turn AS line, CASE role WHEN 'assistant' THEN 'generated' WHEN 'user' THEN 'error' ELSE 'rejected' END AS status, text FROM conversations)"


def _cache(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("role") == "assistant", "generated").when(F.col("role") == "user", "error").otherwise("rejected")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("line"), status.alias("status"), "text")


@query(f"WITH {_CACHE} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM k WHERE status = 'generated')")
def resume_pending(spark, sf_dir):
    """Planned ids without a generated result."""
    done = _cache(spark, sf_dir).where("status = 'generated'").select(F.col("id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query(f"WITH {_CACHE} SELECT id, max_by(text, (line, text)) AS text FROM k WHERE status = 'generated' GROUP BY id")
def last_generated_wins(spark, sf_dir):
    return _cache(spark, sf_dir).where("status = 'generated'").groupBy("id").agg(F.max(F.struct("line", "text")).alias("m")).select("id", "m.text")


@query(
    f"""WITH {_CACHE}, l AS (SELECT id, max_by(status, (line, text)) AS status FROM k GROUP BY id), s AS (SELECT doc_id, source = 'src3' AS authored, l.status FROM documents LEFT JOIN l ON id = doc_id),
    n AS (SELECT *, CASE WHEN status IS DISTINCT FROM 'generated' AND NOT authored THEN row_number() OVER (PARTITION BY (status IS DISTINCT FROM 'generated' AND NOT authored) ORDER BY doc_id) END AS k FROM s)
    SELECT doc_id, CASE WHEN status = 'generated' THEN 'skipped' WHEN authored THEN 'authored' WHEN k > 400 THEN 'over_limit' WHEN status = 'error' THEN 'error' ELSE coalesce(status, 'generated') END AS state FROM n"""
)
def generation_states(spark, sf_dir):
    """Ordered states of a resumable run: done rows are skipped, authored rows cost nothing, the limit counts the rest.

    The limit's last row is a distributed top-n, so no task ranks all rows.
    """
    last = _cache(spark, sf_dir).groupBy("id").agg(F.max(F.struct("line", "text", "status")).alias("m")).select(F.col("id").alias("doc_id"), "m.status")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("source") == "src3").alias("authored")).join(last, "doc_id", "left")
    open_ = rows.where("NOT (status <=> 'generated') AND NOT authored")
    edge = open_.orderBy("doc_id").limit(400).agg(F.max("doc_id").alias("edge"))
    state = F.expr("CASE WHEN status = 'generated' THEN 'skipped' WHEN authored THEN 'authored' WHEN doc_id > edge THEN 'over_limit' WHEN status = 'error' THEN 'error' ELSE coalesce(status, 'generated') END")
    return rows.crossJoin(F.broadcast(edge)).select("doc_id", state.alias("state"))


@query("SELECT doc_id, generate_series AS copy FROM (SELECT doc_id, unnest(generate_series(1, CASE WHEN toxic = 1 THEN 3 ELSE 1 END)) AS generate_series FROM documents JOIN labels USING (doc_id))")
def upsample(spark, sf_dir):
    """Rows of the rarer route, repeated."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("toxic") == 1, 3).otherwise(1).cast("long"))).alias("copy"))


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE n_chars < 200) AND page_id NOT IN (SELECT item_id FROM benchmark)")
def image_free_pool(spark, sf_dir):
    used = table(spark, sf_dir, "documents").where("n_chars < 200").select(F.col("doc_id").alias("page_id")).unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id")))
    return table(spark, sf_dir, "pages").select("page_id").join(used, "page_id", "left_anti")


@query("WITH p AS (SELECT doc_id, source, lang FROM documents), q AS (SELECT doc_id, toxic FROM labels) SELECT CASE WHEN q.doc_id IS NULL THEN 'no_row' WHEN lang = 'es' THEN 'wrong_split' WHEN toxic = 1 THEN 'wrong_tier' ELSE 'kept' END AS reason, count(*) AS n FROM p LEFT JOIN q USING (doc_id) GROUP BY 1")
def fail_closed_resolve(spark, sf_dir):
    """Rows are kept only when positively resolved; the first reason that drops a row is counted."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    reason = F.when(F.col("toxic").isNull(), "no_row").when(F.col("lang") == "es", "wrong_split").when(F.col("toxic") == 1, "wrong_tier").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY toxic = 1, doc_id) AS k, toxic FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS k FROM p) SELECT doc_id FROM g WHERE (toxic = 1 AND k <= greatest(1, round_even(0.15 * 100, 0))) OR (toxic = 0 AND k <= 100 - greatest(1, round_even(0.15 * 100, 0)))"""
)
def smoke_subset(spark, sf_dir):
    """The first rows of each route, 100 in all, 15 of them refusals: two distributed top-ns."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    u = max(1, round(0.15 * 100))
    return rows.where("toxic = 1").orderBy("doc_id").limit(u).unionByName(rows.where("toxic = 0").orderBy("doc_id").limit(100 - u)).select("doc_id")


@query("SELECT pack, sha256(string_agg(f, chr(10) ORDER BY f)) AS content_key FROM (SELECT source AS pack, doc_id || ':' || sha256(text) AS f FROM documents WHERE text IS NOT NULL) GROUP BY pack")
def content_keys(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", "doc_id", F.sha2("text", 256).alias("digest"))
    return content_key(files, "source", "doc_id", "digest").withColumnRenamed("source", "pack")


_RIGHT = "r AS (SELECT item_id AS doc_id, sha256(text) AS h FROM benchmark UNION ALL SELECT doc_id + 1000000, sha256(text) FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) AND lang = 'en')"


@query(f"WITH l AS (SELECT doc_id, sha256(text) AS h FROM documents), {_RIGHT} SELECT CASE WHEN r.h IS NULL THEN 'only_left' WHEN l.h IS NULL THEN 'only_right' WHEN l.h <> r.h THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM l FULL JOIN r USING (doc_id) GROUP BY 1")
def reconcile_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.sha2("text", 256).alias("h"))
    right = items.unionByName(docs.where("lang = 'es'").select((F.col("doc_id") + 1000000).alias("doc_id"), "h")).unionByName(docs.where("lang = 'en'").join(items.select("doc_id"), "doc_id", "left_anti").select("doc_id", "h"))
    return reconcile(docs.select("doc_id", "h"), right, "doc_id", "h").groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k, count(*) FILTER ((props->>'missing') IS NULL) AS absent FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"), F.count_if(F.get_json_object("props", "$.missing").isNull()).alias("absent"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_recovery(spark, sf_dir):
    """The object inside fences and prose, from its first brace to its last."""
    wrapped = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    found = F.regexp_extract(wrapped, r"(?s)\{.*\}", 0)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"))


@query("SELECT conv_id, bool_or(role = 'user') AND bool_or(role = 'assistant') AS complete FROM conversations GROUP BY conv_id")
def complete_groups(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.bool_or(F.col("role") == "user") & F.bool_or(F.col("role") == "assistant")).alias("complete"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'refuse' ELSE coalesce(nullif(role, 'system'), 'grade') END AS route, role IN ('user', 'system') AS changed FROM conversations")
def migration_backfill(spark, sf_dir):
    """Routes filled only where missing, with a flag of what changed; a second run changes nothing."""
    old = F.when(F.col("role") == "assistant", F.col("role"))
    new = F.coalesce(old, F.when(F.col("role") == "user", "refuse").otherwise("grade"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", new.alias("route"), (~old.eqNullSafe(new)).alias("changed"))


@query("SELECT item_id, list_concat(list_transform(range(8 - 3), lambda i: -100), [item_id, item_id + 1, item_id + 2]) AS labels FROM benchmark")
def label_mask(spark, sf_dir):
    """Prompt positions are masked with -100; the target's ids stay."""
    target = F.array("item_id", F.col("item_id") + 1, F.col("item_id") + 2)
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.array_repeat(F.lit(-100).cast("long"), 5), target).alias("labels"))
