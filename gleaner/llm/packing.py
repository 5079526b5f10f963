"""Best-fit packing by minimum bin slack.

Documents become token sequences with an end id; those over `size` are cut into pieces of `size`, a shorter one
first.  Bins of `size` are then filled one after another: over the lengths still available, a subset-sum dynamic
program on bitsets finds the fullest feasible combination holding the longest piece left, which is removed.

Pieces of one length are alike, so the program runs on the table of lengths (at most `size` rows, whatever the
corpus) and removes a combination as often as its lengths last; the plan is a short list of combinations with
multiplicities.  Pieces find their place in it by their rank among the pieces of their length.  Ranks come from
counts per written partition and a running sum over these, so a length that a third of all pieces has is never held
by one task.

Defined results: a null text is empty and becomes the end id alone; pieces of equal length are dealt in the order of
their rows as written; repeated rows and null keys are each packed; a very long text is encoded whole, so a task needs
some tens of bytes for each of its bytes; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices, tidy
from .carry import pick
from .pieces import pieces, texts_of
from .store import saved

SIZE = 1024
END = 2


def _cut(path: str, size: int, end: int):
    def run(batches):
        last = end.to_bytes(4, "little")
        for batch in batches:
            for part, raw, bounds in slices(batch, "text", 1 << 20):
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(texts_of(part, raw, bounds)):
                    ids = pieces(path).encoded(text) + last
                    n = len(ids) // 4
                    first = n % size or size
                    edges = [0, *range(first, n + 1, size)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
                yield pa.record_batch([part.column("key").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["key", "piece", "start", "length", "crc"])

    return run


def fullest(counts: dict[int, int], size: int) -> list[int]:
    """Lengths (with repeats, longest first) of a fullest bin that holds the longest piece left.

    reach[k] has bit s set when some of the k longest lengths sum to s; each length may be used as often as it is
    there.  Multiples enter in binary portions, so a length costs logarithmically many shifts.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    longest = lengths[0]
    room = size - longest
    mask = (1 << (room + 1)) - 1
    reach, items = [1], []
    for n in lengths:
        if n > room:
            continue
        left, step = min(counts[n] - (n == longest), room // n), 1
        while left > 0:
            use = min(step, left)
            items.append((n, use))
            reach.append((reach[-1] | reach[-1] << (n * use)) & mask)
            left -= use
            step *= 2
            if reach[-1] >> room & 1:
                left = 0
        if reach[-1] >> room & 1:
            break
    best = reach[-1].bit_length() - 1
    out = []
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> best & 1:
            n, use = items[k - 1]
            out += [n] * use
            best -= n * use
    return [longest, *sorted(out, reverse=True)]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Combinations (length -> number) with how many bins each fills."""
    counts, out = {n: c for n, c in counts.items() if c}, []
    while counts:
        use: dict[int, int] = {}
        for n in fullest(counts, size):
            use[n] = use.get(n, 0) + 1
        times = min(counts[n] // k for n, k in use.items())
        for n, k in use.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        out.append((use, times))
    return out


def places(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, number in a bin, offset of the first) for each use of a length."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for use, times in bins:
        at = 0
        for n, k in sorted(use.items(), reverse=True):
            lo = rank.get(n, 0)
            rank[n] = lo + k * times
            out.append((n, lo, rank[n], base, k, at))
            at += n * k
        base += times
    return out


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    spark = df.sparkSession
    rows = pick(df, key=key, text=text).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["key"].dataType.simpleString()
    cut = rows.mapInArrow(tidy(_cut(tokenizer, size, end)), f"key {kind}, piece int, start long, length long, crc long")
    cut = saved(cut.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "pieces")
    # At most `size` lengths per written partition.
    counts = saved(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    table = spark.createDataFrame(places(plan(by_length, size)), "length long, lo long, hi long, base long, k long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("row"))
    ranked = cut.withColumn("place", place).join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("place") - 1)
    # A length's uses lie in one sorted array (the plan has a few thousand at most); the last that starts at or before the rank is the piece's.
    uses = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "base", "k", "at"))).alias("uses"))
    found = ranked.join(F.broadcast(uses), "length").withColumn("use", F.expr("element_at(filter(uses, u -> u.lo <= rank), -1)"))
    turn = F.col("rank") - F.col("use.lo")
    return found.select(
        F.col("key").alias(key), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        (F.col("use.base") + F.expr("(rank - use.lo) div use.k")).alias("sequence_id"),
        (F.col("use.at") + (turn % F.col("use.k")) * F.col("length")).alias("offset"),
    )
