"""Streams with state of their own: bounded newest lists, and sources held to a minimum interval.

Both give, once all input has arrived, what their batch forms give, however the input was split into batches.  They
need the RocksDB state store: `spark.sql.streaming.stateStore.providerClass` (see STORE).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SALTS = 8  #: parts of a shelf, by id, so that no task has all of a busy one

ENTRY = "id string, at timestamp, content string"
LISTED = f"shelf string, part int, entries array<struct<{', '.join(f.replace(' ', ':') for f in ENTRY.split(', '))}>>, evicted array<string>"


def content_id(content) -> F.Column:
    """An entry's name by its content, so that what is added twice is one entry."""
    return F.substring(F.sha2(content, 256), 1, 16)


def _newest(entries: list[tuple], most: int) -> tuple[list[tuple], list[str]]:
    """(id, at, content) -> the last entry of each id, newest first, `most` of them, and the ids that fall off the end."""
    last: dict[str, tuple] = {}
    for e in entries:
        if e[0] not in last or (e[1], e[2]) > (last[e[0]][1], last[e[0]][2]):
            last[e[0]] = e
    order = sorted(last.values(), key=lambda e: (e[1], e[0]), reverse=True)
    return order[:most], [e[0] for e in order[most:]]


class Newest(StatefulProcessor):
    """A shelf's part: its newest entries.  An entry that has fallen off can't return: those before it only get newer."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(e) for e in self.held.get()]
        entries = [(i, a.to_pydatetime() if isinstance(a, pd.Timestamp) else a, c) for i, a, c in before]
        for part in rows:
            entries += [(i, a.to_pydatetime(), c) for i, a, c in zip(part["id"], part["at"], part["content"])]
            entries = _newest(entries, self.most)[0] if len(entries) > 4 * self.most else entries
        kept, _ = _newest(entries, self.most)
        self.held.put(kept)
        gone = sorted({e[0] for e in before} - {e[0] for e in kept})
        listed = [{"id": i, "at": a, "content": c} for i, a, c in kept]
        yield pd.DataFrame({"shelf": [key[0]], "part": [key[1]], "entries": [listed], "evicted": [gone]})

    def close(self) -> None:
        pass


def _shelved(rows: DataFrame) -> DataFrame:
    columns = [F.col(c).cast("string").alias(c) for c in ("shelf", "id")]
    return rows.select(*columns, F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")).where("id IS NOT NULL AND at IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))


def newest_stream(rows: DataFrame, most: int) -> DataFrame:
    """A stream of (shelf, id, at, content) -> each changed part's list after the batch, and what fell off it."""
    return _shelved(rows).groupBy("shelf", "part").transformWithStateInPandas(Newest(most), LISTED, "Update", "None")


def newest_of_lists(lists: DataFrame, most: int, batch: str = "batch") -> DataFrame:
    """Lists as newest_stream emitted them, numbered by batch -> (shelf, rank, id, at, content) as it stands now."""
    now = lists.groupBy("shelf", "part").agg(F.max_by("entries", batch).alias("entries"))
    return _ranked(now.select("shelf", F.explode("entries").alias("e")).select("shelf", "e.*"), most)


def newest(rows: DataFrame, most: int) -> DataFrame:
    """The batch form: (shelf, rank, id, at, content)."""
    last = _shelved(rows).groupBy("shelf", "id").agg(F.max(F.struct("at", "content")).alias("m")).select("shelf", "id", "m.*")
    return _ranked(last, most)


def _ranked(entries: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("shelf").orderBy(F.desc("at"), F.desc("id"))
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("shelf", "rank", "id", "at", "content")


RELEASED = "source string, seq long, at timestamp, released timestamp"


class Spaced(StatefulProcessor):
    """A source's rows, held until the interval since the last one is over and no earlier row can come."""

    def __init__(self, interval_ms: int):
        self.interval = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, seq long")
        self.last = handle.getValueState("last", "released long")

    def _out(self, source: str, rows: list[tuple[int, int]], now: int) -> Iterator[pd.DataFrame]:
        """Rows due by `now` in order of time, then number; a timer for the next one."""
        last = self.last.get()[0] if self.last.exists() else None
        rows, out = sorted(rows), []
        for at, seq in rows:
            due = at if last is None else max(at, last + self.interval)
            if due > now:
                break
            out.append((source, seq, at, due))
            last = due
        if out:
            self.last.update((last,))
        if len(out) == len(rows):
            self.held.clear()
        else:
            self.held.put(rows[len(out) :])
            at = rows[len(out)][0]
            self.handle.registerTimer(at if last is None else max(at, last + self.interval))
        if out:
            found = pd.DataFrame(out, columns=["source", "seq", "at", "released"])
            yield found.assign(at=pd.to_datetime(found["at"], unit="ms"), released=pd.to_datetime(found["released"], unit="ms"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        held = [(a, s) for a, s in self.held.get()]
        for part in rows:
            held += list(zip((part["at"].astype("int64") // {"ns": 1_000_000, "us": 1_000, "ms": 1}[part["at"].dt.unit]).tolist(), part["seq"].tolist()))
        yield from self._out(key[0], held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._out(key[0], [(a, s) for a, s in self.held.get()], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def spaced_stream(rows: DataFrame, interval_ms: int, late: str) -> DataFrame:
    """A stream of (source, seq, at) -> (source, seq, at, released): in order of (at, seq), a source's rows are released at
    least the interval apart and never before they came; `late` is how late rows may come.  A source is one key: its
    rate bounds its rows."""
    columns = rows.select(F.col("source").cast("string").alias("source"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at")).where("at IS NOT NULL")
    return columns.withWatermark("at", late).groupBy("source").transformWithStateInPandas(Spaced(interval_ms), RELEASED, "Append", "EventTime")


def spaced(rows: DataFrame, interval_ms: int) -> DataFrame:
    """The batch form, without a loop: the k-th row is released k intervals after the latest of (at - its own number of
    intervals) so far, a running maximum."""
    order = Window.partitionBy("source").orderBy("at", "seq")
    ms = F.unix_millis("at")
    k = F.row_number().over(order)
    placed = rows.select(F.col("source").cast("string").alias("source"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at")).where("at IS NOT NULL")
    placed = placed.withColumn("k", k.cast("long")).withColumn("ms", ms)
    due = F.max(F.col("ms") - F.col("k") * interval_ms).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k") * interval_ms
    return placed.select("source", "seq", "at", F.timestamp_millis(due).alias("released"))
