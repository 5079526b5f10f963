"""Raw buffers of Arrow columns, without copies into Python strings, and workers that give memory back."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
import pyarrow as pa

BATCH_BYTES = "8m"


def bounded_batches(spark) -> None:
    """Let batches of long texts end by their bytes; a session that sets this itself keeps its own bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m"):
        spark.conf.set(name, BATCH_BYTES)


def tidy(run):
    """Wraps a function over batches: a worker lives on after its task, so what the task has freed goes back to the system."""

    @functools.wraps(run)
    def wrapped(batches):
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays of 1 MB and more return when freed
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and bounds of each row's text; a null row is an empty range."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    n = len(column)
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        keep = np.asarray(column.is_valid())
        if np.diff(bounds)[~keep].any():  # a null may still span bytes
            return text_buffers(column.fill_null("" if not pa.types.is_binary(column.type) else b""))
    return raw, bounds


def slices(batch: pa.RecordBatch, name: str, most: int = 1 << 20):
    """Parts of a batch with about `most` bytes of text each, so that working memory doesn't follow the batch."""
    raw, bounds = text_buffers(batch.column(name))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at), raw, bounds[at : to + 1]
        at = to
