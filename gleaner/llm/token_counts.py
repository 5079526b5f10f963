"""Token counts without ids: pieces of each distinct pre-token, joined to the documents' pre-token frequencies.

A first pass over the texts counts how often each pre-token occurs (summed per task, then over the corpus).  The
pieces of each distinct pre-token are counted once, in a table.  A second pass has each document's pre-token
frequencies; the HOT most frequent pre-tokens, a table of fixed size that goes to every task, are looked up there and
summed at once.  What a document has besides (rare pre-tokens, a small share of its words) joins the whole table by
pre-token and is added to the document's sum.  No document's ids are ever made, and rows that the common pre-tokens
cover are not shuffled.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings of the tokenizer inside a text are
one token each, as the library has it; pre-tokens equally frequent at the edge of HOT may fall on either side, with the
same sums; repeated rows and null keys are each returned; a very long text is split whole, so a task needs some tens
of bytes for each of its bytes; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, tidy
from .carry import pick
from .pieces import pieces, texts_of
from .store import saved

HOT = 200_000  #: pre-tokens that every task has at hand
HOT_CHARS = 40  #: longest of these
HELD = 400_000  #: distinct pre-tokens that a task sums up before it hands them on


def _met(path: str):
    """Pre-tokens and how often they occur, summed as far as a task's table goes."""

    def out(counts):
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    def run(batches):
        split, counts = pieces(path).pre_tokens, Counter()
        for batch in batches:
            for part, raw, bounds in slices(batch, "text"):
                for text in texts_of(part, raw, bounds):
                    counts.update(split(text))
                if len(counts) > HELD:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return run


def _sized(path: str):
    def run(batches):
        for batch in batches:
            for part, _, _ in slices(batch, "token"):
                yield pa.record_batch([part.column("token"), part.column("n"), pa.array(pieces(path).sizes(part.column("token").to_pylist()), pa.int64())], ["token", "n", "pieces"])

    return run


_tables: dict[str, dict[str, int]] = {}


def _table(name: str, shared) -> dict[str, int]:
    """The common pre-tokens as a dictionary, made once a worker."""
    if name not in _tables:
        _tables.clear()
        tokens, sizes = shared.value
        _tables[name] = dict(zip(tokens.to_pylist(), sizes.tolist()))
    return _tables[name]


def _summed(path: str, name: str, shared):
    """Bytes, pieces of common pre-tokens, and the other pre-tokens with their frequencies."""
    rest = pa.map_(pa.string(), pa.int64())

    def run(batches):
        split, size = pieces(path).pre_tokens, _table(name, shared)
        for batch in batches:
            for part, raw, bounds in slices(batch, "text"):
                known, others = [], []
                for text in texts_of(part, raw, bounds):
                    tokens = split(text)
                    missing = Counter(t for t in tokens if t not in size)
                    known.append(sum(map(size.get, (t for t in tokens if t in size))) if missing else sum(map(size.__getitem__, tokens)))
                    others.append(list(missing.items()) or None)
                yield pa.record_batch([part.column("key"), pa.array(np.diff(bounds)), pa.array(known, pa.int64()), pa.array(others, rest)], ["key", "n_bytes", "known", "others"])

    return run


def token_counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 512, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row; tokenizer: path of a byte-level BPE file on every executor."""
    spark = df.sparkSession
    rows = pick(df, key=key, text=text).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["key"].dataType.simpleString()
    met = rows.select("text").mapInArrow(tidy(_met(tokenizer)), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    sizes = saved(met.mapInArrow(tidy(_sized(tokenizer)), "token string, n long, pieces long"), "pieces")
    common = sizes.where(F.length("token") <= HOT_CHARS).orderBy(F.desc("n"), "token").limit(hot).select("token", "pieces").toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast((common.column("token").combine_chunks(), common.column("pieces").to_numpy()))
    counted = rows.mapInArrow(tidy(_summed(tokenizer, uuid.uuid4().hex, shared)), f"key {kind}, n_bytes long, known long, others map<string,bigint>")
    counted = saved(counted.withColumn("row", F.monotonically_increasing_id()), "counted")
    rare = counted.where("others IS NOT NULL").select("row", F.explode("others").alias("token", "times"))
    added = rare.join(sizes, "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    whole = counted.where("others IS NOT NULL").drop("others").join(added, "row").withColumn("known", F.col("known") + F.col("more"))
    out = counted.where("others IS NULL").select("key", "n_bytes", "known").unionByName(whole.select("key", "n_bytes", "known"))
    return out.select(F.col("key").alias(key), "n_bytes", F.col("known").alias("n_tokens"), (F.col("known") > limit).alias("over_limit"))
