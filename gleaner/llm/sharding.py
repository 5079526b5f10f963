"""Sharding by rendezvous hashing: each record goes to the shard that scores highest for its key.

Shard s scores -weight / ln(u), where u in (0, 1) is a hash of (key, s).  Nothing but the key, the shards and their
weights decides, so one more shard takes records only into itself, as many as its weight's share.  Places inside a
shard (gapless from 0, in key order) come from a range partitioning by (shard, key): each partition counts its
records, a running sum over these counts gives each partition its first place.  No shard is ever held by one task.

Defined results: a null key hashes as the text `null`; a null text has size 1 and a null checksum of no bytes (0);
repeated rows each get a place; equal keys share their shard; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import pick
from .store import saved


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard's number; of equal scores the smaller number."""
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def score(s: int, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{s}")).cast("binary")), 1, 12), 16, 10).cast("double")
        return F.struct((F.lit(float(weight)) / -F.ln((bits + 0.5) / float(1 << 48))).alias("score"), F.lit(-s).alias("shard"))

    scores = [score(s, w) for s, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return -best["shard"]


def shard(df: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row; grown: the weights with one more shard."""
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = pick(df, id=key, text=text).select(
        "id",
        (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
        F.crc32(data.cast("binary")).alias("crc"),
        rendezvous(F.col("id"), weights).alias("shard"),
        rendezvous(F.col("id"), grown).alias("grown"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = saved(rows, "records")
    order = ["id", "crc", "size", "tie"]
    dealt = saved(rows.repartitionByRange("shard", *order).withColumn("part", F.spark_partition_id()), "dealt")
    # One row per shard and partition at most, whatever the number of records.
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order))
    return dealt.withColumn("place", place).join(first, ["shard", "part"]).select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.col("grown").cast("int").alias("grown_shard"),
    )


#: DuckDB has no CRC-32; this folds the usual table (made by its rule) over the bytes of a text's hexadecimal form.
CRC_TABLE_SQL = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) r(i)))"


def crc_sql(text: str) -> str:
    data = f"hex(encode({text}))"
    bytes_ = f"list_transform(string_split_regex(regexp_replace({data}, '(..)', '\\1 ', 'g'), ' '), lambda h: ('0x' || nullif(h, ''))::BIGINT)"
    return f"xor(list_reduce(list_filter({bytes_}, lambda b: b IS NOT NULL), lambda a, b: xor(a >> 8, crc_table.t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def sql(shards: int) -> str:
    score = "1.0 / -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"
    return f"""WITH {CRC_TABLE_SQL},
    x AS (SELECT doc_id, s, {score} AS score FROM documents, range({shards + 1}) r(s)),
    p AS (SELECT doc_id, arg_max(s, score) FILTER (s < {shards}) AS shard, arg_max(s, score) AS grown FROM x GROUP BY doc_id),
    d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc_sql("coalesce(text, '')")} AS crc, shard, grown FROM documents JOIN p USING (doc_id) CROSS JOIN crc_table)
    SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, size) - 1 AS slot, grown::INTEGER AS grown_shard FROM d"""
