"""N-gram Jaccard join: documents whose word-shingle sets overlap by 80 % or more, exactly.

The document by n-gram incidence matrix is cut into blocks of n-grams (ranges of their hashes).  Each block turns its
part of the matrix around, counts how many different documents hold each n-gram, and sends only the shared entries
back to their documents.  Counts then add up over the blocks, and three bounds that follow from set sizes discard
documents and pairs before any product is formed:

* links need 5 * overlap >= 4 * union, so a set of n misses at most n // 5 of its n-grams in a partner: a document
  whose shared n-grams number less than n - n // 5 links with nothing;
* partners share an n-gram among the n // 5 + 1 rarest of each (one global order: document frequency, then hash);
* of two sets that first meet at one n-gram, at most the n-grams from there on are common: if `left` counts these,
  9 * min(left, left') >= 4 * (n + n').  This holds sizes within a fifth of each other, too.

What is left is multiplied in blocks of pairs by ranges of n-grams: overlap counts add up from range to range, and a
pair is dropped once the n-grams still to come can't bring it to the bound.  Copies are one row of the matrix from the start (rows are keyed by a
fingerprint of the set).  Very common n-grams, found on a bounded sample, skip the turn-around (they are shared
beyond doubt), so no block holds an n-gram's whole list when that list is long.

Groups of near copies are not expanded into all pairs.  Every n-gram list is first linked to its most typical member
only (whose n-grams the most documents hold); then pairs are formed just between members of one list that are still in different components, which loses no
link between components.

The number of blocks follows the number of entries (BLOCK_BYTES each), so a task's memory does not grow with the
corpus.  A component of texts with very many copies is given to these by a table of the few hot fingerprints.

Defined results: null, empty or wordless texts have n_shingles 0 and link with nothing; a null key keeps its row and
never names a component (a component of null keys only is null); n-grams equally rare are taken by hash, members
equally typical by fingerprint, without effect on the result; repeated rows are each returned; a very long text is
hashed whole, so a task needs some tens of bytes for each of its bytes; keys are whole numbers (a component is named
by its smallest); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, tidy
from .carry import pick
from .graph import components
from .shingles import WORDS, distinct, hashes, mix
from .store import saved

SAMPLE_DOCS = 1000  #: documents looked at for the list of common n-grams
COMMON = 0.02  #: share of the sample from which an n-gram is common
SAMPLE_BYTES = 20_000_000  #: most text in that sample
BLOCK_BYTES = 16 << 20  #: packed entries of a block
ENTRY_BYTES = 12
HOT_COPIES = 1000  #: copies of one text from which it is hot; more in corpora of over a million rows
RANGES = 8  #: ranges of n-grams over which a pair's overlap is added up
PAIRS = 2000  #: pairs multiplied at a time
SEEN = 200_000  #: fingerprints a task remembers so as not to send copies again


def fingerprint(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits that depend on the set alone; two independently mixed sums feed it."""
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets + np.uint64(0x51ED270B7A1F3C49)), out=total[1:])
    other = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets ^ np.uint64(0xA24BAED4963EE407)), out=other[1:])
    one, two = total[bounds[1:]] - total[bounds[:-1]], other[bounds[1:]] - other[bounds[:-1]]
    return mix(one + mix(two) * np.uint64(3) + np.diff(bounds).astype(np.uint64))


def _sets(batch, words):
    for part, raw, bounds in slices(batch, "text"):
        values, at = distinct(*hashes(raw, bounds, words))
        yield part, values, at


def _sizes(words):
    def run(batches):
        for batch in batches:
            for part, values, at in _sets(batch, words):
                n = np.diff(at)
                yield pa.record_batch([part.column("key"), pa.array(n), pa.array(fingerprint(values, at).view(np.int64), mask=n == 0)], ["key", "n", "fp"])

    return run


def _pack(block, fp, n, value, more=None) -> dict[int, bytes]:
    """Runs of equal (block, fp): bytes per block of run heads (fp, n, length) and of the n-grams."""
    out = {}
    order = np.argsort(block, kind="stable")
    block, fp, n, value = block[order], fp[order], n[order], value[order]
    more = more[order] if more is not None else None
    cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(block)).tolist()):
        f, m = fp[a:b], n[a:b]
        head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        parts = [np.array([len(head), b - a], np.int64), f[head], m[head].astype(np.uint32), np.diff(np.append(head, b - a)).astype(np.uint32), value[a:b]]
        out[int(block[a])] = b"".join(x.tobytes() for x in ([*parts, more[a:b]] if more is not None else parts))
    return out


def _unpack(blob, more=False):
    """(fp, n, value[, more]) with one entry for each n-gram."""
    data = memoryview(blob)
    heads, size = np.frombuffer(data[:16], np.int64).tolist()
    at, out = 16, []
    for kind, count in ((np.uint64, heads), (np.uint32, heads), (np.uint32, heads), (np.uint64, size), *(((np.uint32, size),) if more else ())):
        step = np.dtype(kind).itemsize * count
        out.append(np.frombuffer(data[at : at + step], kind))
        at += step
    return [np.repeat(out[0], out[2]), np.repeat(out[1], out[2]), *out[3:]]


def _rows(blobs: dict[int, bytes], kind: int = 0) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(blobs), pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array(list(blobs.values()), pa.binary())], ["block", "kind", "payload"])


BLOBS = "block int, kind int, payload binary"


def _incidence(words, blocks, common):
    """Entries of the matrix, packed by block; entries of common n-grams go to a block by document."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, values, at in _sets(batch, words):
                n = np.diff(at)
                fp = fingerprint(values, at)
                keep = n > 0
                for i, x in enumerate(fp.tolist()):
                    if keep[i]:
                        if x in seen:
                            keep[i] = False
                        elif len(seen) < SEEN:
                            seen.add(x)
                entry = np.repeat(keep, n)
                value, owner, size = values[entry], np.repeat(fp, n)[entry], np.repeat(n, n)[entry]
                hot = np.zeros(len(value), bool)
                if len(common):
                    hot = common[np.minimum(np.searchsorted(common, value), len(common) - 1)] == value
                for kind, part in ((0, ~hot), (1, hot)):
                    if part.any():
                        by = value[part] if kind == 0 else owner[part]
                        yield _rows(_pack(((by >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32), owner[part], size[part], value[part]), kind)

    return run


def _turn(blocks, common, often):
    """Within each block: keep entries whose n-gram has two documents or more, with that number, by document block.

    Common n-grams take their number from the sample, the same everywhere, since their lists are not together here.
    """

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block, kind, blob in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("payload")):
                held.setdefault((block, kind), []).append(blob.as_buffer().to_pybytes())
        while held:
            (_, kind), blobs = held.popitem()
            parts = [_unpack(x) for x in blobs]
            fp, n, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
            del parts, blobs
            if kind == 0:
                order = np.argsort(value)
                ordered = value[order]
                same = ordered[1:] == ordered[:-1]
                shared = np.zeros(len(value), bool)
                shared[order[1:]] |= same
                shared[order[:-1]] |= same
                fp, n, value = fp[shared], n[shared], value[shared]
            order = np.lexsort((fp, value))
            fp, n, value = fp[order], n[order], value[order]
            fresh = np.ones(len(value), bool)
            fresh[1:] = (value[1:] != value[:-1]) | (fp[1:] != fp[:-1])
            fp, n, value = fp[fresh], n[fresh], value[fresh]
            if not len(value):
                continue
            head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            count = np.diff(np.append(head, len(value)))
            df = np.repeat(count, count).astype(np.uint32)
            if kind == 1:
                df = often[np.searchsorted(common, value)]
            order = np.lexsort((value, fp))
            order = order[df[order] > 1]
            if len(order):
                fp, n, value, df = fp[order], n[order], value[order], df[order]
                yield _rows(_pack(((fp >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32), fp, n, value, df))

    return run


def _survivors(batches):
    """Add up each document's shared n-grams over the blocks; keep documents that may link, with their rarest ones."""
    held: dict[int, list] = {}
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("payload")):
            held.setdefault(block, []).append(blob.as_buffer().to_pybytes())
    while held:
        _, blobs = held.popitem()
        parts = [_unpack(x, True) for x in blobs]
        fp, n, value, df = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.argsort(fp, kind="stable")
        fp, n, value, df = fp[order], n[order].astype(np.int64), value[order], df[order]
        head = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        count = np.diff(np.append(head, len(fp)))
        out = {k: [] for k in ("fp", "n", "shared", "typical", "grams", "rarest")}
        for a, m in zip(head.tolist(), count.tolist()):
            size = int(n[a])
            if m < size - size // 5:
                continue
            v, d = value[a : a + m], df[a : a + m]
            first = np.lexsort((v, d))[: max(0, size // 5 + 1 - (size - m))]
            out["fp"].append(int(fp[a].view(np.int64)))
            out["n"].append(size)
            out["shared"].append(m)
            out["typical"].append(float(np.log2(d).sum() / size))
            out["grams"].append(np.sort(v).tobytes())
            out["rarest"].append(v[first].view(np.int64).tolist())
        if out["fp"]:
            yield pa.record_batch([pa.array(out["fp"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["shared"], pa.int64()), pa.array(out["typical"], pa.float64()), pa.array(out["grams"], pa.binary()), pa.array(out["rarest"], pa.list_(pa.int64()))], list(out))


def _products(batches):
    """Overlap counts of a block of pairs, added up over ranges of n-grams, and the links among them.

    9 * overlap >= 4 * (n + n') is the link's condition; a pair goes as soon as all that is left of its shorter row
    can't bring it there.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, PAIRS):
            part = batch.slice(at, PAIRS)
            need = 4 * (np.asarray(part.column("xn")) + np.asarray(part.column("yn")))
            sides = [_ranged(part.column(name)) for name in ("xs", "ys")]
            rest = np.minimum(*[np.cumsum(sizes[:, ::-1], axis=1)[:, ::-1] for _, _, sizes in sides])
            overlap = np.zeros(part.num_rows, np.int64)
            alive = 9 * rest[:, 0] >= need
            for k in range(RANGES):
                pair, gram = [], []
                for values, starts, sizes in sides:
                    n = np.where(alive, sizes[:, k], 0)
                    first = np.repeat(starts[:, k] - (np.cumsum(n) - n), n)
                    gram.append(values[first + np.arange(len(first))])
                    pair.append(np.repeat(np.arange(len(n)), n))
                pair, gram = np.concatenate(pair), np.concatenate(gram)
                order = np.lexsort((gram, pair))
                gram, pair = gram[order], pair[order]
                both = (gram[1:] == gram[:-1]) & (pair[1:] == pair[:-1])
                overlap += np.bincount(pair[1:][both], minlength=part.num_rows)
                alive &= 9 * (overlap + (rest[:, k + 1] if k + 1 < RANGES else 0)) >= need
            keep = pa.array(alive)
            yield pa.record_batch([part.column("x").filter(keep), part.column("y").filter(keep)], ["x", "y"])


def _ranged(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed rows of sorted n-grams -> (values, starts, sizes), the last two by row and range of n-grams."""
    raw, bounds = _binary(column)
    values = np.frombuffer(raw.tobytes(), np.uint64)
    row = np.repeat(np.arange(len(column)), np.diff(bounds // 8))
    block = (values >> np.uint64(32)) * np.uint64(RANGES) >> np.uint64(32)
    sizes = np.bincount(row * RANGES + block.astype(np.int64), minlength=len(column) * RANGES)
    return values, (np.cumsum(sizes) - sizes).reshape(-1, RANGES), sizes.reshape(-1, RANGES)


def _binary(column):
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def common_grams(texts: DataFrame, words: int, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams in COMMON or more of a bounded sample (SAMPLE_DOCS texts, SAMPLE_BYTES) and in how many documents they
    should be; what the sample misses costs balance only."""
    picked = texts.where("text IS NOT NULL").select("text", F.xxhash64(F.col("text")).alias("h"), F.length("text").alias("size"))
    rows = picked.where(f"size <= {SAMPLE_BYTES // SAMPLE_DOCS}").select(F.col("h"), "text").orderBy("h").limit(SAMPLE_DOCS).toArrow()
    if rows.num_rows < 100:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    grams = [np.unique(v) for batch in rows.select(["text"]).combine_chunks().to_batches() for _, v, _ in _each(batch, words)]
    value, count = np.unique(np.concatenate(grams), return_counts=True)
    keep = count >= max(8, COMMON * rows.num_rows)
    return value[keep], np.clip(count[keep] * (documents / rows.num_rows), 2, 2**32 - 1).astype(np.uint32)


def _each(batch, words):
    for part, values, at in _sets(batch, words):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield part, values[a:b], None


def survivors(texts: DataFrame, words: int, blocks: int, documents: int) -> DataFrame:
    """One row per distinct set that may link: fp, n, how many are shared, typical, the shared n-grams and the rarest, in order."""
    common, often = common_grams(texts, words, documents)
    entries = texts.select("text").mapInArrow(tidy(_incidence(words, blocks, common)), BLOBS)
    turned = entries.repartitionById(blocks, F.col("block")).mapInArrow(tidy(_turn(blocks, common, often)), BLOBS)
    return turned.repartitionById(blocks, F.col("block")).mapInArrow(tidy(_survivors), "fp long, n long, shared long, typical double, grams binary, rarest array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of fingerprints that do link."""
    left = sets.select(F.col("fp").alias("x"), F.col("n").alias("xn"), F.col("grams").alias("xs"))
    right = sets.select(F.col("fp").alias("y"), F.col("n").alias("yn"), F.col("grams").alias("ys"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "xn", "yn", "xs", "ys").mapInArrow(tidy(_products), "x long, y long")


#: Different sets of one size n share n - 1 of n + 1 at most, sets of other sizes the smaller of the larger.
_MAY_LINK = "9 * least(left, oleft) >= 4 * (n + on) AND CASE WHEN n = on THEN n >= 9 ELSE 5 * least(n, on) >= 4 * greatest(n, on) END"


def starred(lists: DataFrame) -> DataFrame:
    """Each member of an n-gram's list with the list's most typical member."""
    hub = lists.groupBy("gram").agg(F.max(F.struct("typical", "fp", "n", "left")).alias("hub"), F.count("*").alias("many")).where("many > 1").select("gram", F.col("hub.fp").alias("ofp"), F.col("hub.n").alias("on"), F.col("hub.left").alias("oleft"))
    return lists.join(hub, "gram").where(f"fp <> ofp AND {_MAY_LINK}").select(F.least("fp", "ofp").alias("x"), F.greatest("fp", "ofp").alias("y")).distinct()


def _bucket(n: str):
    """Sizes within a fifth of each other are in the same bucket or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("int")


def crossing(lists: DataFrame) -> DataFrame:
    """Pairs of one list whose members are in different components, from the smaller side; they meet by size, too."""
    main = (
        lists.groupBy("gram", "label").agg(F.count("*").alias("c"))
        .groupBy("gram").agg(F.max_by("label", "c").alias("main"), F.count("*").alias("labels"))
        .where("labels > 1").select("gram", "main")
    )
    mixed = lists.join(main, "gram")
    near = F.explode(F.array(*[_bucket("n") + k for k in (-1, 0, 1)]))
    minor = mixed.where("label <> main").select("gram", near.alias("size"), F.col("fp").alias("ofp"), F.col("n").alias("on"), F.col("left").alias("oleft"), F.col("label").alias("olabel"))
    pairs = minor.join(mixed.select("gram", _bucket("n").alias("size"), "fp", "n", "left", "label"), ["gram", "size"]).where(f"label <> olabel AND {_MAY_LINK}")
    return pairs.select(F.least("fp", "ofp").alias("x"), F.greatest("fp", "ofp").alias("y")).distinct()


def ngram_jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, blocks: int | None = None) -> DataFrame:
    """(key, n_shingles, component_id) for every row of df; see the module's docstring.

    blocks: number of n-gram blocks; by default as many as the entries need, and the session's shuffle partitions
    at least.
    """
    spark = df.sparkSession
    texts = pick(df, key=key, text=text).select(F.col("key").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    sizes = saved(texts.mapInArrow(tidy(_sizes(words)), "key long, n long, fp long"), "sizes")
    rows, entries = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries * ENTRY_BYTES // BLOCK_BYTES))
    sets = saved(survivors(texts, words, blocks, rows), "sets")
    lists = sets.select("fp", "n", "shared", "typical", F.posexplode("rarest").alias("place", "gram")).withColumn("left", F.col("shared") - F.col("place"))
    links = saved(verified(starred(lists), sets), "links")
    found = saved(components(links), "labels")
    labelled = lists.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    pairs = saved(crossing(labelled), "pairs")
    if not pairs.isEmpty():
        more = saved(verified(pairs, sets), "links")
        if not more.isEmpty():
            found = saved(components(links.unionByName(more)), "labels")
    firsts = sizes.where("fp IS NOT NULL").groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    named = firsts.join(found.withColumnRenamed("node", "fp"), "fp").groupBy("label").agg(F.min("first").alias("component"))
    linked = found.join(named, "label").select(F.col("node").alias("fp"), "component")
    classes = saved(firsts.join(linked, "fp", "left").select("fp", "copies", F.coalesce("component", "first").alias("component")), "classes")
    # Hot fingerprints are HOT_COPIES rows each or a thousandth of all, so there are a thousand or so: they go to every task.
    edge = max(HOT_COPIES, rows // 1000)
    hot = F.broadcast(classes.where(F.col("copies") >= edge).select("fp", "component"))
    out = sizes.join(hot, "fp").unionByName(sizes.join(hot, "fp", "left_anti").join(classes.where(F.col("copies") < edge).select("fp", "component"), "fp", "left"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("key")).otherwise(F.col("component")).alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
      ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) END AS grams FROM w),
e AS (SELECT doc_id, unnest(grams) AS gram FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 80 * (len(x.grams) + len(y.grams) - k)),
pairs AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other)
SELECT s.doc_id, len(s.grams) AS n_shingles, r.component_id FROM s JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) r ON r.id = s.doc_id
"""
