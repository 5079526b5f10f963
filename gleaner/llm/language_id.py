"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (1 to 3 characters of the lower-cased text) per language on a bounded sample: at most
TRAIN_ROWS labelled rows, those with the smallest hash of their key, then of text and language; equal rows with equal keys count once.  Counts are summed by Spark; the smoothed
log-probability matrix, BUCKETS by languages, is sent to the tasks (32768 x 8 bytes a language, and the sample has
TRAIN_ROWS languages at most).  Scoring takes the whole text: n-grams are counted per document, and the sparse counts
are multiplied with the matrix in numpy, LANGUAGES languages at a time.

Defined results: `und` with score 0 where the text is null or has no letter, or where nothing was learnt; ties go to
the language that sorts first; the score is the posterior probability under equal priors per language.  Repeated rows
are each returned; extra columns are ignored.  A very long text is scored in pieces of PIECE characters that overlap
by what an n-gram needs, so its n-grams are those of the whole text and memory does not follow its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, tidy
from .carry import pick

BUCKETS = 1 << 15
TRAIN_ROWS = 3000
LANGUAGES = 64  #: columns of the matrix that are multiplied at a time
PIECE = 1 << 20
ORDERS = (1, 2, 3)
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def _grams(texts: list[str], starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each n-gram of lower-cased texts; of a single text only those in its first `starts` places."""
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    docs, buckets = [], []
    for n in ORDERS:
        if len(codes) < n:
            break
        last = len(codes) - n + 1 if starts is None else min(starts, len(codes) - n + 1)
        value = np.full(last, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            value = (value ^ codes[k : k + last]) * np.uint32(_MULTIPLIERS[k])
            value ^= value >> np.uint32(15)
        inside = owner[:last] == owner[n - 1 : n - 1 + last]
        docs.append(owner[:last][inside])
        buckets.append((value[inside] % np.uint32(BUCKETS)).astype(np.int32))
    return np.concatenate(docs or [np.zeros(0, np.int32)]), np.concatenate(buckets or [np.zeros(0, np.int32)])


def _sparse(texts: list[str], starts: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the n-grams there are, documents in order."""
    doc, bucket = _grams(texts, starts)
    dense = np.bincount(doc.astype(np.int64) * BUCKETS + bucket, minlength=len(texts) * BUCKETS)
    at = np.flatnonzero(dense)
    return at // BUCKETS, at % BUCKETS, dense[at]


def _pieces(texts: list[str]):
    """(places, texts, starts): up to 64 texts at a time; of a long text a piece at a time, with what its last n-grams need."""
    for at in range(0, len(texts), 64):
        short = [i for i in range(at, min(at + 64, len(texts))) if len(texts[i]) <= PIECE]
        if short:
            yield np.array(short), [texts[i] for i in short], None
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            for a in range(0, len(t), PIECE):
                yield np.array([i]), [t[a : a + PIECE + max(ORDERS) - 1]], min(PIECE, len(t) - a)


def _strings(raw, bounds) -> list[str]:
    data = memoryview(raw)
    return [str(data[a:b], "utf-8").lower() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _train(batches):
    for batch in batches:
        for part, raw, bounds in slices(batch, "text", 1 << 18):
            texts, langs = _strings(raw, bounds), part.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                count = np.zeros(BUCKETS, np.int64)
                for _, some, starts in _pieces([t for t, x in zip(texts, langs) if x == lang]):
                    count += np.bincount(_grams(some, starts)[1], minlength=BUCKETS)
                at = np.flatnonzero(count)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(count[at], pa.int64())], ["lang", "bucket", "n"])


def matrix(counts: dict[tuple[str, int], int], langs: list[str]) -> np.ndarray:
    """Logarithms of the smoothed shares of buckets, a column per language."""
    where = {x: i for i, x in enumerate(langs)}
    n = np.ones((BUCKETS, len(langs)))
    for (lang, bucket), count in counts.items():
        n[bucket, where[lang]] += count
    return np.log(n / n.sum(axis=0)) if langs else n


def train(rows: DataFrame, bound: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """rows (key, text, lang), labelled -> (languages, matrix of log-probabilities, BUCKETS by languages)."""
    picked = rows.where("lang IS NOT NULL").withColumn("h", F.struct(F.xxhash64(F.col("key").cast("string")).alias("key"), F.xxhash64("text", "lang").alias("row")))
    edge = picked.select("h").orderBy("h").limit(bound).agg(F.max("h").alias("edge"))
    sample = picked.join(F.broadcast(edge), F.col("h") <= F.col("edge")).select("h", "text", "lang").dropDuplicates(["h"]).select("text", "lang")
    counts = sample.mapInArrow(tidy(_train), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    return langs, matrix({(lang, bucket): n for lang, bucket, n in zip(*(table.column(c).to_pylist() for c in ("lang", "bucket", "n")))}, langs)


def _predict(shared):
    def run(batches):
        langs, matrix = shared.value
        for batch in batches:
            for part, raw, bounds in slices(batch, "text", 1 << 20):
                texts = _strings(raw, bounds)
                total = np.zeros((len(texts), len(langs)))
                for owner, some, starts in _pieces(texts):
                    doc, bucket, count = _sparse(some, starts)
                    if len(doc):
                        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                        for k in range(0, len(langs), LANGUAGES):
                            sums = np.add.reduceat(matrix[bucket, k : k + LANGUAGES] * count[:, None], head, axis=0)
                            np.add.at(total[:, k : k + LANGUAGES], owner[doc[head]], sums)
                letter = [any(map(str.isalpha, t)) for t in texts]
                if langs:
                    best = total.argmax(axis=1)
                    odds = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter)]
                    score = np.where(letter, odds, 0.0)
                else:
                    names, score = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.record_batch([part.column("key"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["key", "held_out", "lang_pred", "score"])

    return run


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = TRAIN_ROWS) -> DataFrame:
    """(key, held_out, lang_pred, score) for every row; a null key is never held out."""
    rows = pick(df, key=key, text=text, lang=lang).select("key", F.col("text").cast("string").alias("text"), F.coalesce(held_out("key"), F.lit(False)).alias("held_out"), F.col("lang").cast("string").alias("lang"))
    model = train(rows.where("NOT held_out").select("key", "text", "lang"), bound)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text", "held_out").mapInArrow(tidy(_predict(shared)), f"key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)
