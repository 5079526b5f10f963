"""Incremental forms: resumable append caches, bounded newest lists and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, in micro-batches, then stop; the checkpoint remembers what is done."""
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
    query.awaitTermination()


def upsert_latest(target: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends results; `latest` reads back the last generated one of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(target)

    return write


def latest(rows: DataFrame, key: str, order: list[str], done: Column) -> DataFrame:
    """The last finished row of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.where(done).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("m")).select(key, "m.*")


def pending(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return plan.join(done.select(key), key, "left_anti")


def tumbling(events: DataFrame, every: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; on a stream, rows later than `late` are dropped."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
