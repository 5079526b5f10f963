"""Event windows and incremental runs; the batch forms have SQL, the streaming forms are tested against them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.components import shared_folder
from ..operators.enrich import enrich
from ..registry import query
from ..sources.tables import table
from ..streaming import caches, stateful


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def extra_tumbling(spark, sf_dir):
    return caches.tumbling(table(spark, sf_dir, "events"), "1 hour").select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, event_type, count(*) AS n FROM events, range(2) t(k) GROUP BY ALL")
def extra_sliding(spark, sf_dir):
    return caches.sliding(table(spark, sf_dir, "events"), "1 hour", "30 minutes").select(F.col("w.start").alias("start"), "event_type", "n")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(max(value), 6) AS top FROM s GROUP BY user_id, k"""
)
def extra_session(spark, sf_dir):
    return caches.sessions(table(spark, sf_dir, "events"), "30 minutes").select("user_id", F.col("w.start").alias("start"), "n", F.round("top", 6).alias("top"))


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def latest_per_key(spark, sf_dir):
    """Last entry of an append-only cache per key."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", "m.event_id")


NEWEST = 50
_ENTRIES = {"shelf": "o_orderpriority", "id": "cast(o_custkey AS string)", "at": "cast(o_orderdate AS timestamp)", "content": "o_orderstatus"}
_NEWEST_SQL = f"""WITH l AS (SELECT o_orderpriority AS shelf, o_custkey::VARCHAR AS id, max((o_orderdate::TIMESTAMP, o_orderstatus)) AS m FROM orders GROUP BY ALL),
    r AS (SELECT shelf, id, m[1] AS at_time, m[2] AS content, row_number() OVER (PARTITION BY shelf ORDER BY m[1] DESC, id DESC) AS rank FROM l) SELECT shelf, rank, id, at_time, content FROM r WHERE rank <= {NEWEST}"""


@query(_NEWEST_SQL)
def gallery(spark, sf_dir):
    """The newest entries of each shelf, one for each id."""
    return stateful.newest(table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _ENTRIES.items()]), NEWEST).withColumnRenamed("at", "at_time")


@query(_NEWEST_SQL)
def gallery_by_stream(spark, sf_dir):
    """The same by a stream in three batches, whose state holds each shelf's newest entries only."""
    base = f"{shared_folder(spark)}/gallery-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _ENTRIES.items()])
    for k in range(3):
        rows.where(F.pmod(F.xxhash64("id", "at"), F.lit(3)) == k).coalesce(1).write.parquet(f"{base}/in/part={k}")

    def write(lists, number):
        lists.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{base}/out")

    before = spark.conf.get(*stateful.STORE)
    spark.conf.set(*stateful.STORE)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/part=*")
        caches.drain(stateful.newest_stream(stream, NEWEST), write, f"{base}/mark", "update")
    finally:
        spark.conf.set(stateful.STORE[0], before)
    return stateful.newest_of_lists(spark.read.parquet(f"{base}/out"), NEWEST).withColumnRenamed("at", "at_time")


INTERVAL_MS = 900_000


@query(
    f"""WITH k AS (SELECT user_id::VARCHAR AS source, event_id AS seq, ts, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
    SELECT source, seq, max(ms - k * {INTERVAL_MS}) OVER (PARTITION BY source ORDER BY ts, seq) + k * {INTERVAL_MS} - ms AS waited_ms FROM k"""
)
def release_times(spark, sf_dir):
    """How long each user's events wait if they are let through a quarter of an hour apart."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return stateful.spaced(rows, INTERVAL_MS).select("source", "seq", (F.unix_millis("released") - F.unix_millis("at")).alias("waited_ms"))


@query("SELECT page_id, md5(coalesce(html, '')) AS digest, 'b' AS version, strlen(coalesce(html, ''))::BIGINT AS size, len(string_split(coalesce(html, ''), '<'))::BIGINT - 1 AS tags FROM pages")
def enriched_pages(spark, sf_dir):
    """Pages measured in three runs: half of them, then all, of which half is reused, then all at another version."""
    path = f"{shared_folder(spark)}/enriched-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.md5("html"))

    def measure(rows):
        return rows.select("page_id", F.octet_length("html").cast("long").alias("size"), (F.size(F.split("html", "<")) - 1).cast("long").alias("tags"))

    for rows, version in ((pages.where("page_id % 2 = 0"), "a"), (pages, "a"), (pages, "b")):
        out, _ = enrich(rows, path, version, measure, "page_id")
    return out.select("page_id", "digest", "version", "size", "tags")
