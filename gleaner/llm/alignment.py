"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids these links join.

A dangling-suffix transducer reads both token sequences of a text.  Its state is the side that leads and the bytes
that the other side has yet to match; it reads the next token of the side that lags, and a group closes when nothing is
left over.  Transitions are memoised by (state, next token) for a worker's life, so that bytes are compared once for each
residual and token that ever meet.

Side A is a byte-level BPE over space + text, side B a sentencepiece model over the text, which adds that space itself.
Special strings inside texts are plain text.  The groups' last tokens are linked.  One of two linked tokens ends with
the other's bytes, so there are at most as many linked id pairs as tokens have suffixes among tokens (some hundred
thousand for vocabularies of this size), however large the corpus: their counts go to every task.

Long texts are cut where neither side has a token across: before one space between two ASCII letters, for vocabularies
without pieces over a space.  So the encoders' memory follows the cut, a text's ids are four bytes each.  Words between
such spaces start and end with no state left over, so a worker runs each word through encoders and transducer once and
holds what came of it, for some WORDS of them at a time.

The saved table holds a token in four bytes, twice its id and one more where a group ends: two binary values a row, which
Spark moves whole, where arrays would be taken apart by element each time they are written or read.

Defined results: a text that is null, empty, or not reproduced byte by byte by both sides has no tokens, groups or
links; repeated rows and null keys are each returned, and their links each count; equal counts are all best; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, text_buffers, tidy
from .carry import pick
from .pieces import byte_letters, pieces, texts_of
from .store import saved

PART = 300  #: characters that side B encodes at a time, about: it takes more than in proportion to its text
BLOCK = 1 << 15  #: characters of a long text that are aligned at a time, or groups that are written
RUN = 1 << 17  #: characters of texts that one side encodes before the other does
MEMO = 2_000_000  #: transitions that a worker holds before it starts anew
WORDS = 250_000  #: words that a worker holds before it starts anew, or 16 characters for each
GAP = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
PLAIN_ENDS = "!-~À-ÖØ-öø-ÿΑ-ΡΣ-ωА-я"  #: no white space, no marks that join another character
BETWEEN = re.compile(f" (?<=[{PLAIN_ENDS}] )(?=[{PLAIN_ENDS}])")


class State(dict):
    """What one side has ahead of the other, and the memoised state after each next token of the side that lags."""

    __slots__ = ("of", "a_leads", "reads_a", "rest")

    def __init__(self, of: Transducer, a_leads: bool, rest: bytes):
        self.of, self.a_leads, self.rest = of, a_leads, rest
        self.reads_a = not a_leads

    def __missing__(self, token: int) -> State:
        to = self[token] = self.of.after(self, token)
        return to


class Transducer:
    """`zero` has nothing left over and reads side A; `broken` is where bytes have differed."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b = a, b
        self.clear()

    def clear(self) -> None:
        self.steps = 0
        self.zero, self.broken = State(self, False, b""), State(self, True, b"")
        self.states = {(False, b""): self.zero, (True, b""): self.zero}

    def after(self, state: State, token: int) -> State:
        """The state after this token of the side that lags."""
        if state is self.broken:
            return state
        self.steps += 1
        new = (self.a if state.reads_a else self.b)[token]
        if state is self.zero:
            to = (True, new)
        elif state.rest.startswith(new):
            to = (state.a_leads, state.rest[len(new) :])
        elif new.startswith(state.rest):
            to = (not state.a_leads, new[len(state.rest) :])
        else:
            return self.broken
        return self.states.setdefault(to, State(self, *to))

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of a, and how many of b, have been read as each group closes; None where bytes differ."""
        if self.steps > MEMO:
            self.clear()
        state = zero = self.zero
        ends_a: list[int] = []
        ends_b: list[int] = []
        closed_a, closed_b, of_b, j = ends_a.append, ends_b.append, iter(b).__next__, 0
        try:
            for i, token in enumerate(a, 1):
                state = state[token]
                while not state.reads_a:
                    state = state[of_b()]
                    j += 1
                if state is zero:
                    closed_a(i)
                    closed_b(j)
        except StopIteration:  # side B has ended inside a group, or bytes differ
            return None
        return (ends_a, ends_b) if state is zero and j == len(b) else None


class Sides:
    """Both tokenizers of a worker, the bytes of their tokens, and the transducer between them."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor

        self.a = pieces(a)
        self.b = SentencePieceProcessor(model_file=b)
        letters, names = byte_letters(), [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        library = self.a.library
        of_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in ((library.id_to_token(i) or "") for i in range(library.get_vocab_size()))]
        self.of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.transducer = Transducer(of_a, self.of_b)
        self.widths = [np.array([len(t) for t in of], np.int64) for of in (of_a, self.of_b)]
        # A byte-level side without a normaliser, of whose tokens each byte is one, gives every text back; side B is compared with it.
        self.a_is_whole = library.normalizer is None and library.pre_tokenizer is not None and {bytes([k]) for k in range(256)} <= set(of_a) and self.a.byte_level
        self.cuts = self.a.byte_level and not any(re.search("[^▁]▁", p) for p in names) and self.b.encode("ab cd") == self.b.encode("ab") + self.b.encode("cd")
        self.forget()

    def forget(self) -> None:
        """Hold no words: word k has the tokens from bound k to k + 1 of each side; none where a side doesn't reproduce it."""
        self.place: dict[str, int] = {}
        self.tokens, self.bounds, self.held = (array("i"), array("i")), (array("q", [0]), array("q", [0])), 0

    def parts(self, text: str, most: int):
        """The text in parts of about `most` characters, without the spaces at which it is cut."""
        at = 0
        while self.cuts and len(text) - at > most and (gap := GAP.search(text, at + most)):
            yield text[at : gap.start()]
            at = gap.end()
        yield text[at:] if at else text

    def runs(self, texts: list[str | None]):
        """(row, block) of all texts, in lists of about RUN characters."""
        run, size = [], 0
        for row, text in enumerate(texts):
            for block in self.parts(text, BLOCK) if text else ():
                run.append((row, block))
                size += len(block)
                if size >= RUN:
                    yield run
                    run, size = [], 0
        if run:
            yield run

    def lines(self, words: list[str]):
        """The words in lists whose texts have about PART characters; alone where a text of them would not be cut between them."""
        line, size = [], 0
        for k, word in enumerate(words, 1):
            line.append(word)
            size += len(word) + 1
            if size >= PART or not self.cuts or k == len(words):
                yield from [line] if len(line) == 1 or len(BETWEEN.split(" ".join(line))) == len(line) else ([w] for w in line)
                line, size = [], 0

    def learn(self, lines: list[list[str]]) -> None:
        """Align the words of these lines, which are not held.

        One side encodes all of them before the other does, then the transducer reads them: each has tables of the size of a
        processor's cache, which turns by line would fetch anew.
        """
        texts, encode = [" ".join(line) for line in lines], self.b.EncodeAsIds
        of_a = [self.a.plain_ids(" " + text) for text in texts]
        of_b = [encode(text) if len(text) <= 2 * PART else [i for part in self.parts(text, PART) for i in encode(part)] for text in texts]
        ends = [self.transducer.groups(a, b) if self.a_is_whole or self.whole(text, b) else None for text, a, b in zip(texts, of_a, of_b)]
        good = [k for k, end in enumerate(ends) if end is not None]
        words = [w for k in good for w in lines[k]]
        until = np.cumsum([len(w.encode()) + 1 for w in words])
        broken = [line for line, end in zip(lines, ends) if end is None]
        alone = [line[0] for line in broken if len(line) == 1]
        for side, of in enumerate((of_a, of_b)):
            ids = np.fromiter(chain.from_iterable(of[k] for k in good), np.int32)
            marked, before = 2 * ids, np.cumsum([0, *(len(of[k]) for k in good)])
            for k, at in zip(good, before):
                marked[np.array(ends[k][side], np.int64) + (at - 1)] += 1
            bounds = len(self.tokens[side]) + np.searchsorted(np.cumsum(self.widths[side][ids]), until, "right")
            self.tokens[side].frombytes(marked.tobytes())
            self.bounds[side].frombytes(bounds.astype(np.int64).tobytes())
            self.bounds[side].extend([len(self.tokens[side])] * len(alone))
        words += alone
        self.place |= zip(words, range(len(self.place), len(self.place) + len(words)))
        self.held += sum(map(len, words))
        if again := [[w] for line in broken if len(line) > 1 for w in line]:
            self.learn(again)

    def marked_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """For each text the tokens of both sides, as twice the id and one more where a group ends; None where a side doesn't
        reproduce it, or it has none."""
        found: list[list | None] = [[] for _ in texts]
        for run in self.runs(texts):
            words = [BETWEEN.split(block) if self.cuts else [block] for _, block in run]
            every = list(chain.from_iterable(words))
            self.learn(list(self.lines([w for w in dict.fromkeys(every) if w not in self.place])))
            at = np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))
            first = np.cumsum([0, *map(len, words)])
            (a, bounds_a), (b, bounds_b) = (_gathered(np.frombuffer(t, np.int32), np.frombuffer(k, np.int64), at) for t, k in zip(self.tokens, self.bounds))
            broken = np.diff(bounds_a) == 0
            broken = np.add.reduceat(broken, first[:-1]) > 0
            for (row, _), *ends, bad in zip(run, bounds_a[first[:-1]], bounds_a[first[1:]], bounds_b[first[:-1]], bounds_b[first[1:]], broken):
                if bad:
                    found[row] = None
                elif found[row] is not None:
                    found[row].append((a[ends[0] : ends[1]], b[ends[2] : ends[3]]))
            if len(self.place) > WORDS or self.held > 16 * WORDS:
                self.forget()
        return [(tuple(np.concatenate(x) for x in zip(*f)) if len(f) > 1 else f[0]) if f else None for f in found]

    def align_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, ...] | None]:
        """For each text the ids of both sides and the sizes of each group on both sides; None where a side doesn't reproduce it, or it has none."""
        return [m and (*(x >> 1 for x in m), *map(_group_sizes, m)) for m in self.marked_all(texts)]

    def whole(self, block: str, b: list[int]) -> bool:
        return b"".join([self.of_b[i] for i in b]) == (" " + block).encode()

    def align(self, text: str):
        return self.align_all([text])[0]


def _group_sizes(marked: np.ndarray) -> np.ndarray:
    return np.diff(np.flatnonzero(marked & 1), prepend=-1).astype(np.int32)


def _gathered(values: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered `at` out of all lists, one after the other, and their bounds."""
    sizes = bounds[at + 1] - bounds[at]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(bounds[at] - out[:-1], sizes) + np.arange(out[-1])], out


_made: dict[tuple[str, str], Sides] = {}
ARRAYS = ("a_ids", "b_ids", "a_sizes", "b_sizes")
MARKED = ("a", "b")


def sides(a: str, b: str) -> Sides:
    """This worker's instance."""
    if (a, b) not in _made:
        _made[a, b] = Sides(a, b)
    return _made[a, b]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    bounds = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *values]), pa.int32()))


def _aligned(a: str, b: str):
    nothing = (np.zeros(0, np.int32),) * 2

    def run(batches):
        marked_all = sides(a, b).marked_all
        for batch in batches:
            for part, raw, bounds in slices(batch, "text"):
                found = [f or nothing for f in marked_all(texts_of(part, raw, bounds))]
                yield pa.record_batch([part.column("key"), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(2))], ["key", *MARKED])

    return run


def aligned_bytes(df: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, a, b) for every row, as a saved table: the tokens of space + text on both sides, each as four bytes, twice its id and
    one more where a group ends.  a, b: paths of a tokenizers file and of a sentencepiece model on every executor."""
    rows = pick(df, key=key, text=text).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["key"].dataType.simpleString()
    return saved(rows.mapInArrow(tidy(_aligned(a, b)), f"key {kind}, a binary, b binary"), "aligned")


def align(df: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, a_ids, b_ids, a_sizes, b_sizes) for every row: ids of space + text on both sides, and how many of each side's
    tokens every group has.  The same as `aligned_bytes`, as arrays."""

    def run(batches):
        for batch in batches:
            for rows, values, bounds in _part_lists(batch):
                lists = [pa.ListArray.from_arrays(pa.array(k.astype(np.int32)), pa.array(v.astype(np.int32))) for v, k in zip(values, bounds)]
                yield pa.record_batch([batch.column("key")[rows.start : rows.stop], *lists], ["key", *ARRAYS])

    kept = aligned_bytes(df, a, b, key, text)
    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(tidy(run), f"key {kind}, " + ", ".join(f"{c} array<int>" for c in ARRAYS))


def _columns(batch: pa.RecordBatch):
    """(values, bounds) of ids and group sizes, out of arrays or of tokens in four bytes each."""
    if ARRAYS[0] in batch.schema.names:
        columns = [batch.column(c) for c in ARRAYS]
        return [(c.values.to_numpy(), c.offsets.to_numpy()) for c in columns]
    ids, sizes = [], []
    for raw, bounds in (text_buffers(batch.column(c)) for c in MARKED):
        bounds = bounds // 4
        marked = raw[: 4 * bounds[-1]].view(np.int32)[bounds[0] :]
        bounds = bounds - bounds[0]
        ends = np.flatnonzero(marked & 1)
        ids.append((marked >> 1, bounds))
        sizes.append((np.diff(ends, prepend=-1), np.searchsorted(ends, bounds)))
    return ids + sizes


def _part_lists(batch: pa.RecordBatch, most: int = 1 << 20):
    """Batches of about `most` tokens of side A: (rows, their values and bounds by column)."""
    values, bounds = zip(*_columns(batch))
    at, n = 0, batch.num_rows
    while at < n:
        to = min(max(int(np.searchsorted(bounds[0], bounds[0][at] + most, "right")) - 1, at + 1), n)
        yield slice(at, to), [v[s[at] : s[to]] for v, s in zip(values, bounds)], [s[at : to + 1] - s[at] for s in bounds]
        at = to


def _links(values, bounds, width: int) -> np.ndarray:
    """The last tokens of every group, as one number a link.  Groups' sizes add up to a row's tokens."""
    a, b, a_sizes, b_sizes = values
    return a[np.cumsum(a_sizes) - 1].astype(np.int64) * width + b[np.cumsum(b_sizes) - 1]


def _counted(width: int):
    def run(batches):
        for batch in batches:
            for _, values, bounds in _part_lists(batch):
                link, n = np.unique(_links(values, bounds, width), return_counts=True)
                yield pa.record_batch([pa.array(link), pa.array(n.astype(np.int64))], ["link", "n"])

    return run


WIDTH = 1 << 24  #: more than any id of side B


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): how many links hold the pair, and whether none of that b_id's pairs has more."""
    met = aligned.drop("key").mapInArrow(tidy(_counted(WIDTH)), "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    met = saved(met.select((F.col("link") / WIDTH).cast("int").alias("a_id"), (F.col("link") % WIDTH).cast("int").alias("b_id"), "n"), "links")
    return met.join(met.groupBy("b_id").agg(F.max("n").alias("most")), "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def _stream(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """All groups' tokens in the order they are written, each as 3 * id + what follows it: 0 another of its side, 1 side B, 2 the next group."""
    ends_a, ends_b = np.cumsum(a_sizes), np.cumsum(b_sizes)
    out = np.empty(len(a) + len(b), np.int64)
    follow_a, follow_b = 3 * a.astype(np.int64), 3 * b.astype(np.int64)
    follow_a[ends_a - 1] += 1
    follow_b[ends_b - 1] += 2
    out[np.arange(len(a)) + np.repeat(ends_b - b_sizes, a_sizes)] = follow_a
    out[np.arange(len(b)) + np.repeat(ends_a, b_sizes)] = follow_b
    return out


def _written(stream: np.ndarray, bounds: np.ndarray, words: pa.Array):
    """sha256 of `a1,a2|b1;a3|b2,b3` for the rows of a stream, each without its last semicolon; BLOCK tokens are written at a time."""
    row, digest = 0, hashlib.sha256()
    for at in range(0, max(len(stream), 1), BLOCK):
        text, ends = text_buffers(words.take(pa.array(stream[at : at + BLOCK])))
        here = 0
        while row < len(bounds) - 1 and bounds[row + 1] < at + len(ends):
            if bounds[row + 1] == bounds[row]:
                yield ""
            else:
                to = int(ends[bounds[row + 1] - at])
                digest.update(text[here : to - 1])
                yield digest.hexdigest()
                digest, here = hashlib.sha256(), to
            row += 1
        digest.update(text[here : int(ends[-1])])


def _digested(shared):
    def run(batches):
        links, counts, best = shared.value
        words = pa.array([], pa.binary())
        for batch in batches:
            for rows, values, bounds in _part_lists(batch):
                stream = _stream(*values)
                if len(words) <= stream.max(initial=0):
                    words = pa.array([b"%d%c" % (i, end) for i in range((int(stream.max()) // 3 | 0xFFFF) + 1) for end in b",|;"], pa.binary())
                at = np.searchsorted(links, _links(values, bounds, WIDTH))
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[bounds[2]]) for x in (counts, best.astype(np.int64))]
                shas = list(_written(stream, (bounds[0] + bounds[1]).astype(np.int64), words))
                size = [pa.array(np.diff(s).astype(np.int64)) for s in (bounds[0], bounds[1], bounds[2], bounds[2])]
                yield pa.record_batch([batch.column("key")[rows.start : rows.stop], *size, pa.array(sums[1]), pa.array(sums[0]), pa.array(shas, pa.string())], DIGEST)

    return run


DIGEST = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def digest(aligned: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each of `aligned`: sizes, how many links are best for their b_id, the sum of links' counts, and a digest of the groups."""
    table = counts.select((F.col("a_id").cast("long") * WIDTH + F.col("b_id")).alias("link"), "n", "best").orderBy("link").toArrow()
    shared = aligned.sparkSession.sparkContext.broadcast((table.column("link").to_numpy(), table.column("n").to_numpy(), table.column("best").to_numpy(zero_copy_only=False)))
    kind = aligned.schema["key"].dataType.simpleString()
    out = aligned.mapInArrow(tidy(_digested(shared)), f"key {kind}, " + ", ".join(f"{c} long" for c in DIGEST[1:7]) + ", groups_sha256 string")
    return out.withColumnRenamed("key", key)
