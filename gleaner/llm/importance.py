"""Importance resampling towards a target distribution, by hashed n-gram features counted in DuckDB inside the tasks.

Each task hands its texts, some megabytes at a time, to a DuckDB of its own: SQL cuts them into words, unnests these,
windows them to n-grams, hashes each distinct n-gram of the block by a registered CRC-32 function and counts buckets for
each text.  These counts are spilled to a Parquet table in the shared folder.  Spark merges them: over the corpus and over the
target texts to the gain of each bucket (one row a bucket, a parameter), and over each document to its weight.  A
Gumbel draw from the document's key is added to the weight, and the highest scores are drawn without replacement; ranks come from a
range partitioning, so no task holds all scores.

Texts of more than PIECE bytes are cut between words; a later piece repeats the words that n-grams over the cut need, so
counts are those of the whole text and a task's memory follows the piece.

Defined results: a null or empty text has no features, weight 0 and is never drawn (it has under MIN_WORDS words); a
null key hashes as the text `null`, and ranks before others of the same score; repeated rows each take part; equal scores go to the smaller key; an
empty target gives t = T = 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selection import numbered
from .arrow import slices, tidy
from .carry import pick
from .sharding import CRC_TABLE_SQL, crc_sql
from .store import saved

LONGEST = 1  #: words of the longest feature
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
PIECE = 1 << 20  #: bytes of text that are one row in DuckDB
BLOCK = 4 << 20  #: bytes of text of one DuckDB query
#: A word's bytes, of the lower-cased text: digits, letters and whatever is not ASCII.
WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _pieces(raw: np.ndarray, at: int, end: int, longest: int):
    """(bytes, words to leave out) of a text in raw[at:end]; cut after whole words, the words before a cut repeated as far as needed."""
    again = 0
    while end - at > PIECE:
        stop = at + PIECE
        while stop < end and _WORD[raw[stop]]:
            stop += 1
        if stop == end:
            break
        yield raw[at:stop].tobytes(), again
        back, again = stop, 0
        while again < longest - 1 and back > at:
            while back > at and not _WORD[raw[back - 1]]:
                back -= 1
            if back > at:
                again += 1
            while back > at and _WORD[raw[back - 1]]:
                back -= 1
        at = back if again else stop
    yield raw[at:end].tobytes(), again


def _block_sql(longest: int, buckets: int) -> str:
    """Counts of one block: texts(row, text, again) -> row, n_words, buckets, times."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = ["SELECT row, piece, word AS gram, place, 1 AS n, again FROM w"]
    for n in range(2, longest + 1):
        rows = f"OVER (PARTITION BY piece ORDER BY place ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
        grams.append(f"SELECT row, piece, string_agg(word, ' ' ORDER BY place) {rows} AS gram, place, count(*) {rows} AS n, again FROM w QUALIFY count(*) {rows} = {n}")
    return f"""WITH split AS (SELECT row, piece, again, regexp_extract_all({lower}, '{WORDS}') AS words FROM texts),
    w AS (SELECT row, piece, again, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
    g AS (SELECT row, gram FROM ({" UNION ALL ".join(grams)}) WHERE place + n - 1 > again),
    hashed AS (SELECT gram, crc(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM g)),
    counted AS (SELECT row, bucket::INTEGER AS bucket, count(*) AS times FROM g JOIN hashed USING (gram) GROUP BY ALL),
    lists AS (SELECT row, list(bucket) AS buckets, list(times) AS times FROM counted GROUP BY row)
    SELECT s.row, s.n_words, coalesce(buckets, []) AS buckets, coalesce(times, []) AS times
    FROM (SELECT row, sum(greatest(len(words) - again, 0))::BIGINT AS n_words FROM split GROUP BY row) s LEFT JOIN lists USING (row)"""


def _crc(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g.encode()) for g in grams.to_pylist()], pa.uint32())


def _counter(longest: int, buckets: int):
    sql = _block_sql(longest, buckets)
    given = pa.schema([("row", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("again", pa.int64())])
    found = [("row", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]

    def run(batches):
        import duckdb

        def counted(duck, held):
            """Counts of (key, row, bytes, words to leave out)."""
            keys, rows, texts, again = zip(*held)
            columns = [pa.array(rows, pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(again, pa.int64())]
            duck.register("texts", pa.table(columns, schema=given))
            out = duck.sql(sql).to_arrow_table().cast(pa.schema(found))
            duck.unregister("texts")
            of_row = dict(zip(rows, keys))
            yield from out.add_column(0, "key", pa.array([of_row[r] for r in out.column("row").to_pylist()], kind)).combine_chunks().to_batches()

        with duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "800MB", "temp_directory": ""}) as duck:
            duck.create_function("crc", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
            held, size = [], 0
            for batch in batches:
                kind = batch.column("key").type
                for part, raw, bounds in slices(batch, "text", BLOCK):
                    for key, row, at, end in zip(part.column("key").to_pylist(), part.column("row").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                        for piece, again in _pieces(raw, at, end, longest):
                            held.append((key, row, piece, again))
                            size += len(piece)
                            if size >= BLOCK:
                                yield from counted(duck, held)
                                held, size = [], 0
            if held:
                yield from counted(duck, held)

    return run


def feature_counts(df: DataFrame, key: str, text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(key, row, n_words, buckets, times) as a saved table, at least once for every row of df, by its number `row`; a
    text in pieces has several, whose sums are the text's."""
    rows = pick(df, key=key, text=text).select("key", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["key"].dataType.simpleString()
    return saved(rows.mapInArrow(tidy(_counter(longest, buckets)), f"key {kind}, row long, n_words long, buckets array<int>, times array<long>"), "features")


def _totals(counts: DataFrame, name: str) -> DataFrame:
    return counts.select(F.explode(F.arrays_zip("buckets", "times")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.times").alias(name))


def gains(counts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: 1000 times the log of its smoothed share in the target over that in the corpus."""
    table = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(_totals(counts, "s"), "bucket", "left").join(_totals(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    table = saved(table, "buckets")
    whole = table.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = (F.col(c).cast("double") for c in "st")
    ratio = (t + 1.0) * (F.col("all_s") + float(buckets)) / ((s + 1.0) * (F.col("all_t") + float(buckets)))
    return table.crossJoin(F.broadcast(whole)).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def gumbel(key: Column, seed: str) -> Column:
    """Thousandths of a Gumbel variable, from the first 32 bits of a digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """(key, n_features, weight, score, rank) for every row; rank is null for rows that are not drawn."""
    counts = feature_counts(df, key, text, longest, buckets)
    gain = gains(counts, feature_counts(target, target_text, target_text, longest, buckets), buckets)
    met = counts.select("key", "row", "n_words", F.posexplode_outer(F.arrays_zip("buckets", "times")).alias("at", "x"))
    met = met.join(F.broadcast(gain), F.col("x.buckets") == F.col("bucket"), "left")
    words = F.sum(F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("n_words")).otherwise(0))
    met = met.groupBy("row").agg(F.first("key").alias("key"), words.alias("n_words"), F.coalesce(F.sum("x.times"), F.lit(0)).alias("n"), F.sum(F.col("gain") * F.col("x.times")).alias("sum"))
    weight = F.expr("CASE WHEN n > 0 THEN (sum - pmod(sum, n)) div n ELSE 0L END")
    scored = saved(met.select("row", "key", "n_words", F.col("n").alias("n_features"), weight.alias("weight"), (weight + gumbel(F.col("key"), seed)).alias("score")), "scores")
    can = scored.where(F.col("n_words") >= min_words)
    most = percent * can.count() // 100
    placed = numbered(can, [F.desc("score"), F.asc("key"), F.asc("row")]).withColumn("rank", F.when(F.col("n") < most, F.col("n") + 1))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = ["key", "n_features", "weight", "score", "rank"]
    return placed.select(*out).unionByName(rest.select(*out)).withColumnRenamed("key", key)


def sql(longest: int = LONGEST, buckets: int = BUCKETS) -> str:
    """The same of `documents` towards `benchmark`, for features of one word."""
    assert longest == 1
    words = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"
    return f"""WITH {CRC_TABLE_SQL},
    d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({words}, []) AS words FROM documents),
    dw AS (SELECT row, unnest(words) AS word FROM d), bw AS (SELECT unnest({words}) AS word FROM benchmark),
    hashed AS (SELECT word, {crc_sql("word")} % {buckets} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw) CROSS JOIN crc_table),
    met AS (SELECT row, bucket, count(*) AS times FROM dw JOIN hashed USING (word) GROUP BY ALL),
    s AS (SELECT bucket, sum(times) AS s FROM met GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
    x AS (SELECT b AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range({buckets}) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
    gains AS (SELECT bucket, floor(1000.0 * ln((t + 1) * (sum(s) OVER () + {buckets}) / ((s + 1) * (sum(t) OVER () + {buckets}))))::BIGINT AS gain FROM x),
    w AS (SELECT row, sum(times)::BIGINT AS n, sum(gain * times)::BIGINT AS g FROM met JOIN gains USING (bucket) GROUP BY row),
    v AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (row)),
    y AS (SELECT doc_id, n_features, weight, (weight + floor(-1000.0 * ln(-ln((h + 0.5) / 4294967296.0))))::BIGINT AS score FROM v),
    z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS k, {PERCENT} * count(*) FILTER (n_features >= {MIN_WORDS}) OVER () // 100 AS most FROM y)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND k <= most THEN k END AS rank FROM z"""
