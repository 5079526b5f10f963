"""Lookup tables as array columns: resampling to another number of nodes, and Hald images of them.

A table is a row (key, n, values): n^3 nodes of three channels, blue varying fastest, as an array of doubles.  Tables of a
batch that have the same n are computed together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import ADOBE_GAMMA, ADOBE_XYZ, RGB_XYZ
from .measure import AT_ONCE, hald_table, looked_up, read_png


def gathered(nodes: DataFrame, key: str, n: int) -> DataFrame:
    """nodes (key, r, g, b, x, y, z) -> (key, n, values)."""
    held = F.sort_array(F.collect_list(F.struct("r", "g", "b", F.array("x", "y", "z").alias("v"))))
    return nodes.groupBy(key).agg(held.alias("m")).select(key, F.lit(n).alias("n"), F.flatten(F.transform("m", lambda s: s["v"])).alias("values"))


def spread(tables: DataFrame, key: str) -> DataFrame:
    """The inverse of `gathered`."""
    at, n = F.col("at"), F.col("n")
    rows = tables.select(key, "n", "values", F.explode(F.sequence(F.lit(0), n * n * n - 1)).alias("at"))
    return rows.select(key, "n", F.floor(at / (n * n)).cast("int").alias("r"), (F.floor(at / n) % n).cast("int").alias("g"), (at % n).cast("int").alias("b"), *[F.get("values", at * 3 + k).alias(c) for k, c in enumerate("xyz")])


def resampled_to(tables: np.ndarray, m: int) -> np.ndarray:
    """[table, r, g, b, channel] at m nodes an axis: trilinear, one axis after the other, by gathering two layers each."""
    n = tables.shape[1]
    if n == m:
        return tables
    at = np.linspace(0, n - 1, m) if m > 1 else np.zeros(1)
    low = np.clip(at.astype(int), 0, max(n - 2, 0))
    high, part = np.minimum(low + 1, n - 1), at - low
    for axis in (1, 2, 3):
        weight = part.reshape([-1 if k == axis else 1 for k in range(5)])
        tables = np.take(tables, low, axis) * (1 - weight) + np.take(tables, high, axis) * weight
    return tables


def _dense(part: pd.DataFrame, m: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and tables of the same size, as many as have AT_ONCE numbers on the larger of their own and m nodes an axis."""
    sizes = part["n"].to_numpy()
    chunks = []
    for n in np.unique(sizes):
        rows, many = np.flatnonzero(sizes == n), max(1, AT_ONCE // (3 * max(int(n), m) ** 3))
        chunks += [(n, rows[k : k + many]) for k in range(0, len(rows), many)]
    for n, rows in chunks:
        yield rows, np.stack([np.asarray(part["values"].iloc[k], float) for k in rows]).reshape(len(rows), n, n, n, 3)


def resampled(tables: DataFrame, key: str, m: int) -> DataFrame:
    """(key, n, values) with m nodes an axis."""
    kind = tables.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rows, found in _dense(part, m):
                yield pd.DataFrame({"key": part["key"].iloc[rows].to_numpy(), "n": m, "values": list(resampled_to(found, m).reshape(len(rows), -1))})

    return tables.select(F.col(key).alias("key"), "n", "values").mapInPandas(run, f"key {kind}, n int, values array<double>").withColumnRenamed("key", key)


def png(pixels: np.ndarray) -> bytes:
    """An RGB image of bytes [y, x, channel] as a PNG."""
    height, width, _ = pixels.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def hald_image(table: np.ndarray, level: int) -> np.ndarray:
    """Pixels [level^3, level^3, channel] of a table[r, g, b, channel], red fastest along the pixels."""
    edge, side = level * level, level**3
    exact = resampled_to(table[None], edge)[0].transpose(2, 1, 0, 3).reshape(side, side, 3)
    return np.rint(np.clip(exact, 0, 1) * 255).astype(np.uint8)


def to_hald(tables: DataFrame, key: str, level: int | None = None) -> DataFrame:
    """(key, level, content): each table as a Hald PNG; level: the least whose edge, its square, has all nodes."""
    kind = tables.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rows, found in _dense(part, level * level if level else 1):
                size = level or int(np.ceil(np.sqrt(found.shape[1])))
                yield pd.DataFrame({"key": part["key"].iloc[rows].to_numpy(), "level": size, "content": [png(hald_image(t, size)) for t in found]})

    return tables.select(F.col(key).alias("key"), "n", "values").mapInPandas(run, f"key {kind}, level int, content binary").withColumnRenamed("key", key)


def from_hald(images: DataFrame, key: str, m: int | None = None) -> DataFrame:
    """images (key, content) of Hald PNGs -> (key, n, values), at m nodes an axis or their own; what is no Hald image is left out."""
    kind = images.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, content in zip(part["key"], part["content"]):
                try:
                    table = hald_table(read_png(bytes(content)))
                except (ValueError, KeyError, struct.error, zlib.error, TypeError):
                    continue
                table = resampled_to(table[None], m or table.shape[0])[0]
                out.append((name, table.shape[0], table.ravel()))
                if sum(v.size for *_, v in out) >= AT_ONCE:
                    yield pd.DataFrame(out, columns=["key", "n", "values"])
                    out = []
            yield pd.DataFrame(out, columns=["key", "n", "values"])

    return images.select(F.col(key).alias("key"), "content").mapInPandas(run, f"key {kind}, n int, values array<double>").withColumnRenamed("key", key)


def _light(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def _shown(light: np.ndarray) -> np.ndarray:
    return np.where(light <= 0.0031308, light * 12.92, 1.055 * light ** (1 / 2.4) - 0.055)


_WIDEN = np.linalg.inv(np.array(ADOBE_XYZ)) @ np.array(RGB_XYZ)


def srgb_to_adobe(rgb: np.ndarray) -> np.ndarray:
    return np.clip(_light(rgb) @ _WIDEN.T, 0, 1) ** (1 / ADOBE_GAMMA)


def adobe_to_srgb(rgb: np.ndarray) -> np.ndarray:
    return _shown(np.clip(np.clip(rgb, 0, None) ** ADOBE_GAMMA @ np.linalg.inv(_WIDEN).T, 0, 1))


def managed(table: np.ndarray, m: int) -> np.ndarray:
    """A table between AdobeRGB colours as one between sRGB colours, on m nodes an axis."""
    axis = np.linspace(0, 1, m)
    nodes = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1).reshape(-1, 3)
    return adobe_to_srgb(looked_up(table, srgb_to_adobe(nodes))).reshape(m, m, m, 3)


def canonical(tables: DataFrame, key: str, adobe: str, m: int = 17) -> DataFrame:
    """(key, n, values, residual, clipped, residual_sha256): each table cut to [0, 1], colour-managed where the boolean
    column `adobe` says so, on m nodes; residual: its difference from the identity; digested to ten decimals."""
    kind = tables.schema[key].dataType.simpleString()
    axis = np.linspace(0, 1, m)
    identity = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rows, found in _dense(part, m):
                clipped = (found.min(axis=(1, 2, 3, 4)) < 0) | (found.max(axis=(1, 2, 3, 4)) > 1)
                wide, found = part["adobe"].iloc[rows].to_numpy(bool), np.clip(found, 0, 1)
                out = resampled_to(found, m).copy()
                for k in np.flatnonzero(wide):
                    out[k] = managed(found[k], m)
                rest = [t - identity for t in out]
                digest = [hashlib.sha256((np.round(r, 10) + 0.0).astype("<f8").tobytes()).hexdigest() for r in rest]
                yield pd.DataFrame({"key": part["key"].iloc[rows].to_numpy(), "n": m, "values": [t.ravel() for t in out], "residual": [r.ravel() for r in rest], "clipped": clipped, "residual_sha256": digest})

    columns = tables.select(F.col(key).alias("key"), "n", "values", F.coalesce(F.col(adobe), F.lit(False)).alias("adobe"))
    return columns.mapInPandas(run, f"key {kind}, n int, values array<double>, residual array<double>, clipped boolean, residual_sha256 string").withColumnRenamed("key", key)
