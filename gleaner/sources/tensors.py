"""Tensors in .npy files as a Spark data source: read in ranges of their first axis, written one file a row.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").load("hdfs:///store/")            # or one file
    df.select("name", "shape", "values").write.format("npy").mode("append").save("hdfs:///store/")

Files are opened through pyarrow's file systems, by URI.  Headers alone are read to plan: they give type, shape and
where the data begins, and each file is cut into ranges of whole rows of about `rangeBytes`.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RANGE_BYTES = 32 << 20
TASK_BYTES, OPEN_BYTES, TASKS = 32 << 20, 16 << 10, 256  #: most of a task of several ranges, what opening a file counts as, and tasks up to which ranges stay apart
SCHEMA = "name string, row long, shape array<int>, values array<double>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def header(file) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns come first, type, and where the data begins; objects are refused."""
    version = np.lib.format.read_magic(file)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"version {version} of .npy is not read")
    shape, by_columns, kind = read(file)
    if kind.hasobject or kind.kind not in "biuf":
        raise ValueError(f"only numbers are read, not {kind}")
    return shape, by_columns, kind, file.tell()


@dataclass
class Range(InputPartition):
    path: str
    name: str
    shape: tuple[int, ...]
    by_columns: bool
    kind: str
    begin: int  #: of the data
    first: int
    rows: int


@dataclass
class Bundle(InputPartition):
    ranges: list[Range]


def bundled(ranges: list[Range]) -> list[Bundle]:
    """Neighbouring ranges put together, up to TASK_BYTES and to a TASKS-th of all: many small files make few tasks."""
    weights = [OPEN_BYTES + r.rows * int(np.prod(r.shape[1:], dtype=np.int64)) * np.dtype(r.kind).itemsize for r in ranges]
    most = min(TASK_BYTES, sum(weights) / TASKS)
    out, held = [], most
    for r, weight in zip(ranges, weights):
        if held + weight > most:
            out.append(Bundle([]))
            held = 0
        out[-1].ranges.append(r)
        held += weight
    return out


class NpyReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Bundle]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.path.endswith(".npy")]
        out = []
        for file in sorted(files, key=lambda f: f.path):
            with system.open_input_file(file.path) as data:
                shape, by_columns, kind, begin = header(data)
            rows, width = (shape[0], int(np.prod(shape[1:], dtype=np.int64))) if shape else (1, 1)
            if file.size < begin + rows * width * kind.itemsize:
                raise ValueError(f"{file.path} ends before its data")
            step = max(1, self.most // max(1, width * kind.itemsize)) if not by_columns or len(shape) < 2 else max(1, rows)
            for first in range(0, rows, step):
                out.append(Range(file.path, file.base_name.removesuffix(".npy"), shape, by_columns, kind.str, begin, first, min(step, rows - first)))
        return bundled(out) or [Bundle([])]

    def read(self, bundle: Bundle):
        for part in bundle.ranges:
            if part.rows:
                yield from self._read(part)

    def _read(self, part: Range):
        system, _ = opened(self.path)
        kind, width = np.dtype(part.kind), int(np.prod(part.shape[1:], dtype=np.int64))
        with system.open_input_file(part.path) as data:
            data.seek(part.begin + part.first * width * kind.itemsize)
            values = np.frombuffer(data.read(part.rows * width * kind.itemsize), kind)
        if part.by_columns and len(part.shape) > 1:
            values = values.reshape(part.shape, order="F")
        values = np.ascontiguousarray(values, dtype=np.float64).reshape(part.rows, width)
        shape = pa.array([part.shape], pa.list_(pa.int32()))
        step = max(1, (1 << 20) // max(1, width))
        for at in range(0, part.rows, step):
            block = values[at : at + step]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * width), pa.array(block.ravel()))
            rows = pa.array(np.arange(part.first + at, part.first + at + len(block), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([part.name] * len(block), pa.string()), rows, shape.take(pa.array(np.zeros(len(block), np.int32))), lists], ["name", "row", "shape", "values"])


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class NpyWriter(DataSourceWriter):
    """Files are written under a name of this job's own; only a commit of the whole job gives them theirs."""

    def __init__(self, path: str, columns: list[str]):
        missing = {"name", "shape", "values"} - set(columns)
        if missing:
            raise ValueError(f"a tensor needs the columns {sorted(missing)}")
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows) -> Written:
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        moves = []
        for row in rows:
            name = row["name"]
            if not name or "/" in name or "\\" in name:
                raise ValueError(f"not a file's name: {name!r}")
            tensor = np.array(row["values"], np.float64).reshape(row["shape"])
            draft, final = f"{path}/.{name}.{self.job}.{uuid.uuid4().hex}", f"{path}/{name}.npy"
            with system.open_output_stream(draft) as out:
                np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(tensor))
                out.write(tensor.tobytes())
            moves.append((draft, final))
        return Written(moves)

    def commit(self, messages) -> None:
        system, _ = opened(self.path)
        for message in messages:
            for draft, final in message.moves if message else []:
                system.move(draft, final)

    def abort(self, messages) -> None:
        system, _ = opened(self.path)
        for message in messages:
            for draft, _ in message.moves if message else []:
                if system.get_file_info(draft).type != fs.FileType.NotFound:
                    system.delete_file(draft)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        if overwrite:
            raise ValueError("tensors are added by name; use mode('append')")
        return NpyWriter(self.options["path"], schema.names)
