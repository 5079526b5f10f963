"""Whole groups of sorted partitions, many to a batch, for dense kernels that would cost a call for each small group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each run of equal keys; null keys are equal."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = table.column(key)
        found = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= found[1:] != found[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups; the last group of a batch waits for the next one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = int(starts(table, keys)[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last)
    if held is not None:
        yield held.combine_chunks()


def by_groups(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str, order: list[str] | None = None) -> DataFrame:
    """run(table) for tables of whole groups of `keys`, sorted by them (and `order`): a batch and its last group at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            yield from run(table).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(each, schema)
