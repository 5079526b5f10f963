"""Byte-bounded shards, content keys and manifests of file lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shard_files(files: DataFrame, most: int) -> DataFrame:
    """files (pack, name, bytes) -> (pack, name, bytes, shard): within a pack, in name order, a shard is closed before
    the file that would take it over `most`; a larger file is a shard of its own.

    The count restarts with every shard, which is no running sum, so packs are walked in order; a task walks all its packs
    in one pass and holds the count of the last shard only.  Files of one name are in order of size; a null size counts as 0.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, shard, held = object(), 0, 0
        for batch in batches:
            out = []
            for own, size in zip(batch.column("pack").to_pylist(), batch.column("bytes").to_pylist()):
                size = size or 0
                if own != pack:
                    pack, shard, held = own, 0, 0
                elif held and held + size > most:
                    shard, held = shard + 1, 0
                held += size
                out.append(shard)
            yield batch.append_column("shard", pa.array(out, pa.int32()))

    rows = files.select(*[F.col(c).cast("long").alias(c) for c in ("pack", "name", "bytes")])
    return rows.repartition("pack").sortWithinPartitions("pack", "name", "bytes").mapInArrow(walk, "pack long, name long, bytes long, shard int")


def content_key(files: DataFrame, pack: str, name: str, digest: str) -> DataFrame:
    """(pack, content_key): the digest of the sorted name:digest lines; equal keys mean an unchanged pack."""
    line = F.concat(F.col(name).cast("string"), F.lit(":"), F.col(digest))
    return files.groupBy(pack).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("content_key"))


def reconcile(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): only_left, only_right, changed or same."""
    both = left.select(key, F.col(digest).alias("l")).join(right.select(key, F.col(digest).alias("r")), key, "full")
    return both.select(key, F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.col("l") != F.col("r"), "changed").otherwise("same").alias("state"))
