"""Three-dimensional lookup tables as relations of nodes (lut, r, g, b, x, y, z) and as dense arrays.

A node's position is (r, g, b) in 0 .. n - 1; its output colour is (x, y, z).  Stencils are joins on neighbouring
positions or windows along one axis; an application is a join of pixels with the eight nodes around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import by_groups, starts


def grid(spark: SparkSession, n: int) -> DataFrame:
    """The identity table: n^3 nodes, red fastest."""
    i = F.col("id")
    return spark.range(n**3).select((i % n).cast("int").alias("r"), (F.floor(i / n) % n).cast("int").alias("g"), F.floor(i / (n * n)).cast("int").alias("b"))


def parse_cube(files: DataFrame) -> DataFrame:
    """files (name, content) -> (name, n, i, r, g, b, x, y, z) of .cube texts: header keys, then n^3 rows, red fastest."""
    size = F.regexp_extract("content", r"(?m)^\s*LUT_3D_SIZE\s+(\d+)", 1).try_cast("int")
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    rows = F.filter(F.split("content", r"\r?\n"), lambda s: F.regexp_like(s, F.lit(rf"^\s*{number}\s+{number}\s+{number}\s*$")))
    # size and rows are made before rows are written out, so that no node carries its file's text along
    each = files.select("name", size.alias("n"), rows.alias("rows")).select("name", "n", F.posexplode("rows").alias("i", "row")).withColumn("p", F.split(F.trim("row"), r"\s+"))
    return each.select("name", "n", "i", (F.col("i") % F.col("n")).alias("r"), (F.floor(F.col("i") / F.col("n")) % F.col("n")).cast("int").alias("g"), F.floor(F.col("i") / (F.col("n") * F.col("n"))).cast("int").alias("b"), *[F.col("p")[k].cast("double").alias(c) for k, c in enumerate("xyz")])


def classify_cube(content) -> object:
    """struct(kind, error) of a model's text: a table, a refusal, or what is wrong with it, first fault first."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    body = F.trim(F.regexp_replace(content, "(?m)^```[a-z]*\\s*$", ""))
    size = F.regexp_extract(body, r"(?m)^\s*LUT_3D_SIZE\s+(\d+)", 1).try_cast("int")
    rows = F.filter(F.split(body, r"\r?\n"), lambda s: F.regexp_like(s, F.lit(rf"^\s*{number}\s+{number}\s+{number}\s*$")))
    values = F.flatten(F.transform(rows, lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda v: v.cast("double"))))
    refused = F.contains(body, F.lit("<unsupported>"))
    error = (
        F.when(content.isNull(), "null_output").when(body == "", "empty_output").when(refused & (body != "<unsupported>"), "mixed_unsupported").when(refused, F.lit(None))
        .when(size.isNull(), "missing_size").when(F.regexp_like(body, F.lit(r"(?i)\b(nan|inf)\b")), "non_finite").when(F.size(rows) < size * size * size, "truncated").when(F.size(rows) > size * size * size, "too_many_rows")
        .when((F.array_min(values) < -0.02) | (F.array_max(values) > 1.02), "out_of_range")
    )
    kind = F.when(content.isNotNull() & (body == "<unsupported>"), "unsupported").when(error.isNull(), "cube").otherwise("invalid")
    return F.struct(kind.alias("kind"), error.alias("error"))


def serialize_cube(nodes: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, content, sha256): ten decimals, red fastest, line feeds."""
    line = F.concat_ws(" ", *[F.format_string("%.10f", F.when(F.col(c) == 0, 0.0).otherwise(F.col(c))) for c in "xyz"])
    rows = nodes.groupBy(key, n).agg(F.sort_array(F.collect_list(F.struct("b", "g", "r", line.alias("line")))).alias("m"))
    content = F.concat(F.lit("LUT_3D_SIZE "), F.col(n).cast("string"), F.lit("\n"), F.array_join(F.transform("m", lambda s: s["line"]), "\n"), F.lit("\n"))
    return rows.select(key, content.alias("content")).withColumn("sha256", F.sha2("content", 256))


def hald_position(level: int):
    """(r, g, b) expressions of pixel number i in an image of that level."""
    e = level * level
    i = F.col("i")
    return (i % e).alias("r"), (F.floor(i / e) % e).alias("g"), F.floor(i / (e * e)).alias("b")


def apply_trilinear(pixels: DataFrame, nodes: DataFrame, n: int, key: list[str]) -> DataFrame:
    """pixels (key, u, v, w in [0, 1]) -> (key, x, y, z): eight weighted neighbours, by one join on node positions.

    One table of n^3 nodes is small (35,937 at n = 33), which bounds the broadcast.
    """
    t = pixels
    for c in "uvw":
        scaled = F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * (n - 1)
        low = F.least(F.floor(scaled), F.lit(n - 2))
        t = t.withColumn(f"_{c}", low.cast("int")).withColumn(f"_f{c}", scaled - low)
    corner = F.explode(F.array(*[
        F.struct(*[(F.col(f"_{c}") + bit).cast("int").alias(p) for c, bit, p in zip("uvw", bits, "rgb")], (_weight("u", bits[0]) * _weight("v", bits[1]) * _weight("w", bits[2])).alias("k"))
        for bits in [(i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]
    ]))
    spread = t.select(*key, corner.alias("c")).select(*key, "c.*")
    met = spread.join(F.broadcast(nodes.select("r", "g", "b", "x", "y", "z")), ["r", "g", "b"])
    return met.groupBy(*key).agg(*[F.sum(F.col("k") * F.col(c)).alias(c) for c in "xyz"])


def _weight(c: str, bit: int):
    return F.col(f"_f{c}") if bit else 1 - F.col(f"_f{c}")


def residual(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.withColumns({f"d{c}": F.col(c) - F.col(p) / (n - 1) for c, p in zip("xyz", "rgb")})


def residual_rms(nodes: DataFrame, n: int, by: list[str]) -> DataFrame:
    return residual(nodes, n).groupBy(*by).agg(F.sqrt(F.avg((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")) / 3)).alias("rms"))


def _axes():
    for axis, channel in zip("rgb", "xyz"):
        yield axis, channel, [p for p in "rgb" if p != axis]


def foldover(nodes: DataFrame, by: list[str], severe: float = 0.02) -> DataFrame:
    """Share of steps along the three axes on which the mean channel falls by more than `severe`."""
    bright = nodes.withColumn("_m", (F.col("x") + F.col("y") + F.col("z")) / 3)
    steps = None
    for axis, _, rest in _axes():
        order = Window.partitionBy(*by, *rest).orderBy(axis)
        one = bright.select(*by, (F.lead("_m").over(order) - F.col("_m")).alias("d")).where("d IS NOT NULL")
        steps = one if steps is None else steps.unionByName(one)
    return steps.groupBy(*by).agg(F.avg((F.col("d") < -severe).cast("double")).alias("rate"))


def second_difference(nodes: DataFrame, n: int, by: list[str], share: float = 0.99) -> DataFrame:
    """Percentile of the channels' second differences of the residual, scaled to a 17-node axis.

    Tables are dealt out once and sorted by `by` and position; the neighbours on all three axes are found within the batches of
    whole tables.  A difference with a null is none, a NaN is the largest; a table without differences gives no row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", p double"

    def run(tables: pa.Table) -> pa.Table:
        first = starts(tables, by)
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, tables.num_rows)))
        place = {c: tables.column(c).to_numpy() for c in "rgb"}
        d = [tables.column(c).to_numpy().astype(float) for c in ("dx", "dy", "dz")]  # null: NaN
        null = [tables.column(c).is_null().to_numpy() for c in ("dx", "dy", "dz")]
        gaps, of = [], []
        for axis, _, rest in _axes():
            order = np.lexsort((place[axis], place[rest[0]], place[rest[1]], owner))
            inner = np.ones(max(len(order) - 2, 0), bool)
            for line in (owner, place[rest[0]], place[rest[1]]):
                line = line[order]
                inner &= line[2:] == line[:-2]
            for v, missing in zip(d, null):
                v, missing = v[order], missing[order]
                keep = inner & ~(missing[2:] | missing[1:-1] | missing[:-2])
                gaps.append(np.abs(v[2:] - 2 * v[1:-1] + v[:-2])[keep])
                of.append(owner[order][1:-1][keep])
        gaps, of = np.concatenate(gaps), np.concatenate(of)
        gaps, k = gaps[np.lexsort((gaps, of))], np.bincount(of, minlength=len(first))
        found = np.flatnonzero(k)
        at, before = share * (k[found] - 1), (np.cumsum(k) - k)[found]
        low, high = gaps[before + np.floor(at).astype(int)], gaps[before + np.ceil(at).astype(int)]
        part = at - np.floor(at)
        p = np.where((part == 0) | (low == high), low, (1 - part) * low + part * high) * ((n - 1) / 16) ** 2
        return tables.select(by).take(pa.array(first[found])).append_column("p", pa.array(p))

    rows = residual(nodes, n).select(*by, "r", "g", "b", "dx", "dy", "dz")
    return by_groups(rows, by, run, schema)


def support(pixels: DataFrame, n: int, least: int = 32, by: list[str] = []) -> DataFrame:
    """Occupied cells with enough pixels, and the share of pixels in such cells."""
    place = [F.rint(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * (n - 1)).cast("int").alias(p) for c, p in zip("uvw", "rgb")]
    cells = pixels.select(*by, *place).groupBy(*by, "r", "g", "b").agg(F.count("*").alias("k"))
    return cells.groupBy(*by).agg((F.count_if(F.col("k") >= least) / F.count("*")).alias("supported_cell_rate"), (F.sum(F.when(F.col("k") >= least, F.col("k")).otherwise(0)) / F.sum("k")).alias("input_pixel_supported_rate"))
