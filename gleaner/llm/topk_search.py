"""Exact top-k search by inner product with a pivot-distance index.

Vectors are quantised to floor(SCALE * x).  With M the largest norm, x is lifted to (x, sqrt(M^2 - |x|^2)) and a query
to (q, 0); then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the nearest neighbours and the
triangle inequality bounds them.  Each vector is keyed by its nearest pivot and its distance from it.  The index is
sorted by (pivot, distance) and cut into annuli of CHUNK vectors at most, each with the least and largest distance it
holds, so annuli are as many as the vectors need and a pivot with a third of all vectors has many.  Annuli that follow
each other make a range, which a task can hold whole.

A query is first answered inside its own annulus, which gives it a k-th best score.  From distance d to the pivot, an
annulus [lo, hi] lies max(0, d - hi, lo - d) away at least, which bounds the inner products in it from above.  A query
goes once to each range with an annulus that may hold a better score; there the annuli are expanded from the best
bound on, the k-th best score grows with each, and the rest is skipped once its bounds fall below.  On vectors without
structure few annuli can be skipped; the answer is exact either way.

Pivots come from SAMPLE vectors; the ranges' bounds (at most MOST_RANGES ranges) are sent to all tasks.

Defined results: every row is a query (if its id is divisible by `every`) and a candidate for all rows but itself, so
rows that repeat an id count each, and such a query is answered once per row; vectors that are null, empty or hold a
null or non-finite component take no part, nor do null ids; vectors of different lengths have no inner product and
don't meet; queries with fewer than k candidates get all; equal scores go to the smaller id.  Quantised components
and scores are exact and end at the range of a long.  Ids are whole numbers.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import tidy
from .carry import pick
from .store import saved

SCALE = 64
PIVOTS = 16  #: pivots of a vector length, by farthest-first choice from the sample
SAMPLE = 1024  #: vectors that pivots are chosen from
CHUNK = 4096  #: vectors of an annulus
BLOCK = 512  #: queries that travel together
RANGE_BYTES = 64 << 20  #: vectors of a range
MOST_RANGES = 1 << 16  #: beyond it (4 TB of vectors) ranges get longer
_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(0.0, top - (v * v).sum(axis=1)))[:, None]], axis=1)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a from all rows of b."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))


def _pivots(sample: np.ndarray, top: float) -> np.ndarray:
    """Pivots, lifted: each next one is the point farthest from those there are."""
    points = _lift(sample, top)
    chosen = [0]
    near = _gaps(points, points[:1])[:, 0]
    while len(chosen) < min(PIVOTS, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _gaps(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


class Geometry:
    """Pivots by vector length; a length that the sample lacks has the origin."""

    def __init__(self, sample: list[np.ndarray], top: float):
        self.top = top
        by_length: dict[int, list] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        self.pivots = {dim: _pivots(np.stack(vs).astype(np.float64), top) for dim, vs in by_length.items()}

    def of(self, dim: int) -> np.ndarray:
        return self.pivots[dim] if dim in self.pivots else _lift(np.zeros((1, dim)), self.top)

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each vector and the distance from it."""
        gap = _gaps(_lift(v.astype(np.float64), self.top), self.of(v.shape[1]))
        cell = gap.argmin(axis=1)
        return cell, gap[np.arange(len(v)), cell]

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared norms of queries and their distances from all pivots."""
        q = q.astype(np.float64)
        return (q * q).sum(axis=1), _gaps(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.of(q.shape[1]))

    def bound(self, norm: np.ndarray, gap: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query (rows) in each annulus (columns)."""
        d = gap[:, cell]
        away = np.maximum(0.0, np.maximum(d - hi[None, :], lo[None, :] - d))
        whole = norm[:, None] + self.top
        return (whole - away * away) / 2 + 1e-6 * (whole + 1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, ended at the range of a long.

    In floating point while every partial sum is below 2^53, in 64-bit numbers below 2^62, else in Python's own.
    """
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return np.clip(q.astype(object) @ c.astype(object).T, _LOWEST, _HIGHEST).astype(np.int64)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: score down, id up."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((ids[at], -score[at].astype(object) if (score[at] == _LOWEST).any() else -score[at]))[:k]]
    return np.lexsort((ids, -score.astype(object) if (score == _LOWEST).any() else -score))


def _matrix(blob, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(-1, dim)


def _keyed(geometry: Geometry, kind: str):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("v")
            bounds = column.offsets.to_numpy()
            flat, bounds = column.flatten().to_numpy(zero_copy_only=False), bounds - bounds[0]
            size = np.diff(bounds)
            cell, far, blobs = np.zeros(len(size), np.int32), np.zeros(len(size)), np.empty(len(size), object)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                v = flat[bounds[at][:, None] + np.arange(dim)]
                cell[at], far[at] = geometry.place(v)
                blobs[at] = [x.tobytes() for x in v.astype(kind)]
            yield pa.record_batch([batch.column("id"), batch.column("at"), batch.column("query"), pa.array(size, pa.int32()), pa.array(cell), pa.array(far), pa.array(blobs.tolist(), pa.binary())], ["id", "at", "query", "dim", "cell", "far", "v"])

    return run


ANNULI = "part long, dim int, cell int, lo double, hi double, ids binary, ats binary, vs binary, q_ids binary, q_ats binary, q_vs binary, q_floor binary"
_NAMES = [x.split(" ")[0] for x in ANNULI.split(", ")]


def _annuli(k: int, kind: str, parts: int, range_bytes: int):
    """Sorted rows -> annuli: ids, rows and vectors, and the annulus's queries with their k-th best score so far.

    part: the number of the range; it leaves the task's number when divided by `parts`.
    """

    def emit(dim, cell, rows, part):
        ids, ats, asks, far = (np.concatenate([r[i] for r in rows]) for i in range(4))
        v = _matrix(b"".join(b for r in rows for b in r[4]), dim, kind)
        q = np.flatnonzero(asks)
        floor = np.full(len(q), _LOWEST)
        if len(q) and len(ids) > k:
            s = products(v[q], v)
            for j, own in enumerate(q.tolist()):
                others = np.delete(s[j], own)
                floor[j] = np.partition(others, len(others) - k)[len(others) - k]
        return pa.record_batch([pa.array([x]) for x in (part, dim, cell, far[0], far[-1], ids.tobytes(), ats.tobytes(), v.tobytes(), ids[q].tobytes(), ats[q].tobytes(), v[q].tobytes(), floor.tobytes())], _NAMES).cast(
            pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), *[(n, pa.binary()) for n in _NAMES[5:]]])
        )

    def run(batches):
        number, turn, held_bytes = TaskContext.get().partitionId(), 0, 0
        rows, size, now = [], 0, None

        def close():
            nonlocal rows, size, turn, held_bytes
            if rows:
                made = emit(*now, rows, number + turn * parts)
                held_bytes += size * now[0] * np.dtype(kind).itemsize
                if held_bytes >= range_bytes:
                    turn, held_bytes = turn + 1, 0
                rows, size = [], 0
                yield made

        for batch in batches:
            ids, ats, query, dim, cell, far = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "at", "query", "dim", "cell", "far"))
            blobs = batch.column("v").to_pylist()
            cut = np.flatnonzero((np.diff(dim) != 0) | (np.diff(cell) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)]):
                if a == b:
                    continue
                if now != (int(dim[a]), int(cell[a])):
                    yield from close()
                    now = (int(dim[a]), int(cell[a]))
                while a < b:
                    to = min(b, a + CHUNK - size)
                    rows.append((ids[a:to], ats[a:to], query[a:to], far[a:to], blobs[a:to]))
                    size, a = size + to - a, to
                    if size == CHUNK:
                        yield from close()
        yield from close()

    return run


MET = "part long, turn int, dim int, cell int, lo double, hi double, ids binary, ats binary, vs binary, floor binary"
_MET_NAMES = [x.split(" ")[0] for x in MET.split(", ")]


def _routed(geometry: Geometry, kind: str, spans: dict[int, dict[int, tuple]]):
    """Blocks of queries for each range that may improve them; spans: length -> range -> (cells, lows, highs)."""

    def run(batches):
        def emit(dim, blocks):
            ids, ats, v, floor = (np.concatenate([b[i] for b in blocks]) for i in range(4))
            norm, gap = geometry.asked(v)
            for part, (cell, lo, hi) in spans[dim].items():
                at = (geometry.bound(norm, gap, cell, lo, hi) >= floor.astype(np.float64)[:, None]).any(axis=1)
                if at.any():
                    yield pa.record_batch(
                        [pa.array([part], pa.int64()), pa.array([1], pa.int32()), pa.array([dim], pa.int32()), pa.array([0], pa.int32()), pa.array([0.0]), pa.array([0.0]), *[pa.array([x[at].tobytes()], pa.binary()) for x in (ids, ats, v, floor)]],
                        _MET_NAMES,
                    )

        held: dict[int, list] = {}
        for batch in batches:
            for dim, a, b, c, d in zip(*(batch.column(n).to_pylist() for n in ("dim", "q_ids", "q_ats", "q_vs", "q_floor"))):
                if a:
                    block = held.setdefault(dim, [])
                    block.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), _matrix(c, dim, kind), np.frombuffer(d, np.int64)))
                    if sum(len(x[0]) for x in block) >= BLOCK:
                        yield from emit(dim, held.pop(dim))
        for dim, block in held.items():
            yield from emit(dim, block)

    return run


def _searched(geometry: Geometry, kind: str, k: int):
    """A range's annuli, then the blocks of queries sent to it: each query's k best in the range."""

    def answers(annuli, dim, q_ids, q_ats, q, floor):
        own = [x for x in annuli if x[0] == dim]
        norm, gap = geometry.asked(q)
        bound = geometry.bound(norm, gap, np.array([x[1] for x in own]), np.array([x[2] for x in own]), np.array([x[3] for x in own]))
        floor = floor.copy()
        score = [np.zeros(0, np.int64) for _ in q_ids]
        found = [np.zeros(0, np.int64) for _ in q_ids]
        best = bound.max(axis=0)
        for i in np.argsort(-best).tolist():
            if best[i] < floor.min():
                break
            rows = np.flatnonzero(bound[:, i] >= floor.astype(np.float64))
            _, _, _, _, ids, ats, v = own[i]
            s = products(q[rows], v)
            near = (s >= floor[rows][:, None]) & (ats[None, :] != q_ats[rows][:, None])
            for j, r in enumerate(rows.tolist()):
                hit = np.flatnonzero(near[j])
                if len(hit):
                    both, names = np.concatenate([score[r], s[j, hit]]), np.concatenate([found[r], ids[hit]])
                    top = _top(both, names, k)
                    score[r], found[r] = both[top], names[top]
                    if len(top) == k:
                        floor[r] = max(floor[r], score[r][-1])
        many = [len(x) for x in score]
        return pa.record_batch([pa.array(x, pa.int64()) for x in (np.repeat(q_ats, many), np.repeat(q_ids, many), np.concatenate(found), np.concatenate(score))], ["row", "query_id", "vec_id", "score"])

    def run(batches):
        part, annuli = None, []
        for batch in batches:
            for p, turn, dim, cell, lo, hi, a, b, c, d in zip(*(batch.column(n).to_pylist() for n in _MET_NAMES)):
                if p != part:
                    part, annuli = p, []
                ids, ats, v = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), _matrix(c, dim, kind)
                if turn == 0:
                    annuli.append((dim, cell, lo, hi, ids, ats, v))
                else:
                    yield answers(annuli, dim, ids, ats, v, np.frombuffer(d, np.int64))

    return run


def top_k(df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for each row whose id is divisible by `every`, its k best among all other rows."""
    spark = df.sparkSession
    rows = pick(df, id=key, x=vector).select(F.col("id").cast("long").alias("id"), "x").where(
        "id IS NOT NULL AND x IS NOT NULL AND size(x) > 0 AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(double(e)) < double('Infinity'))"
    )
    rows = rows.select("id", F.monotonically_increasing_id().alias("at"), (F.col("id") % every == 0).alias("query"), F.expr(f"transform(x, e -> floor({SCALE}D * double(e)))").alias("v"))
    rows = saved(rows.withColumns({"norm": F.expr("aggregate(v, 0D, (s, e) -> s + double(e) * double(e))"), "most": F.expr("array_max(transform(v, e -> abs(double(e))))")}), "vectors")
    probe = rows.agg(F.max("norm").alias("top"), F.max("most").alias("most"), F.sum(F.size("v")).alias("numbers")).first()
    if probe["numbers"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").withColumnRenamed("vec_id", key)
    kind = "<i4" if probe["most"] < 2**31 else "<i8"
    range_bytes = max(RANGE_BYTES, probe["numbers"] * np.dtype(kind).itemsize // MOST_RANGES)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-probe["numbers"] * np.dtype(kind).itemsize // range_bytes))
    sample = rows.select(F.xxhash64("id", "at").alias("h"), "v").orderBy("h").limit(SAMPLE).select("v").toPandas()["v"]
    geometry = Geometry([np.asarray(v) for v in sample], float(probe["top"]))
    keyed = rows.select("id", "at", "query", "v").mapInArrow(tidy(_keyed(geometry, kind)), "id long, at long, query boolean, dim int, cell int, far double, v binary")
    dealt = keyed.repartitionByRange(parts, "dim", "cell", "far", "at").sortWithinPartitions("dim", "cell", "far", "at")
    annuli = saved(dealt.mapInArrow(tidy(_annuli(k, kind, parts, range_bytes)), ANNULI), "annuli")
    spans: dict[int, dict[int, list]] = {}
    for r in annuli.groupBy("dim", "part", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # a row per range and cell that it meets
        spans.setdefault(r["dim"], {}).setdefault(r["part"], []).append((r["cell"], r["lo"], r["hi"]))
    listed = {dim: {part: tuple(np.array(x) for x in zip(*cells)) for part, cells in by.items()} for dim, by in spans.items()}
    asked = annuli.select("dim", "q_ids", "q_ats", "q_vs", "q_floor").mapInArrow(tidy(_routed(geometry, kind, listed)), MET)
    held = annuli.select("part", F.lit(0).alias("turn"), "dim", "cell", "lo", "hi", "ids", "ats", "vs", F.lit(None).cast("binary").alias("floor"))
    met = held.unionByName(asked).repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).sortWithinPartitions("part", "turn")
    found = met.mapInArrow(tidy(_searched(geometry, kind, k)), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(key), "score")


SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.n <> q.n AND len(c.v) = len(q.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
