"""Quality rules: a learned decision list over text statistics.

Statistics of every whole text are counted in one pass (`text_stats`).  On labelled rows, sequential covering learns
rules for the rarer class: a rule grows by the threshold condition with the best FOIL gain on two thirds of the rows
left, is pruned from its end on the other third, and is kept while its precision there stays at MIN_PRECISION or more
and it covers MIN_COVER rows; rows that it covers are removed before the next one.  The list is emitted as one
ordered Spark conditional expression over the statistics columns.

Learning sees at most FIT_ROWS labelled rows (those with the smallest hash of their key), a few numbers each.

Defined results: a null text has no words, so all statistics are 0 and it fails the base rules; a text of NaN-free
statistics always gets a verdict; without labels of both classes the list is empty and keeps everything; labels that
disagree for one key count as rows of their own; of conditions with equal gain the first in the order of FEATURES, with
the smallest cut, is taken; repeated rows are each returned; a very long text is counted whole, so a task needs some tens
of bytes for each of its bytes; extra columns are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .arrow import slices, tidy
from .carry import carried, pick, restored

FIT_ROWS = 20_000
MIN_COVER = 10
MIN_PRECISION = 0.9
MOST_CONDITIONS = 4
CUTS = 64
WINDOW = 3

#: counts per text, in the order they are emitted
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_letters", "n_upper", "n_digits", "n_bangs", "n_bars", "n_lines")
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _DIGIT, _BANG, _BAR, _UPPER = _table("#*$%&|<>"), _table("0123456789"), _table("!?"), _table("|"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTER[0xC3:0xF5] = True  # first bytes of letters outside ASCII (and of some marks)


def repeated_words(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a WINDOW-word window found twice or more in that text."""
    value, at = shingles.hashes(raw, bounds, WINDOW, lower=False)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    out = np.zeros(len(n), np.int64)
    if not len(value):
        return out
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(v), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    # a window at position p marks words p .. p + WINDOW - 1 of its text; texts get WINDOW - 1 places more than windows
    room = np.where(n > 0, n + WINDOW - 1, 0)
    base = np.concatenate([[0], np.cumsum(room)])
    place = (np.arange(len(v)) - np.repeat(at[:-1], n) + np.repeat(base[:-1], n))[twice]
    mark = np.zeros(base[-1], bool)
    for k in range(WINDOW):
        mark[place + k] = True
    sums = np.concatenate([[0], np.cumsum(mark)])
    return sums[base[1:]] - sums[base[:-1]]


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines)."""
    lines = text.split(b"\n")
    worded = [x for x in lines if x.strip(b" \t\n\r\x0b\f")]
    return len(worded) - len(set(worded)), len(lines)


def _stats(at_text: int):
    def run(batches):
        for batch in batches:
            row = batch.column("row")
            inner = pa.record_batch([row, row.flatten()[at_text]], ["row", "text"])
            for part, raw, bounds in slices(inner, "text"):
                yield pa.record_batch([part.column("row"), *map(pa.array, _counts(raw, bounds))], ["row", *COUNTS])

    return run


def _counts(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    data = raw[bounds[0] : bounds[-1]]
    at = bounds - bounds[0]

    def total(flags):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    separator = _SEPARATOR[data]
    first = ~separator
    first[1:] &= separator[:-1]
    head = at[:-1][at[:-1] < len(data)]
    first[head] = ~separator[head]
    char = (data & 0xC0) != 0x80
    pairs = [_duplicate_lines(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return [
        total(first), total(char & ~separator), total(_SYMBOL[data]), np.array([d for d, _ in pairs], np.int64), repeated_words(raw, bounds), total(char),
        total(_LETTER[data]), total(_UPPER[data]), total(_DIGIT[data]), total(_BANG[data]), total(_BAR[data]), np.array([n for _, n in pairs], np.int64),
    ]


def text_stats(df: DataFrame, text: str) -> DataFrame:
    """(row, COUNTS) for every row; row: the struct of all columns of df by place."""
    rows = carried(df).withColumnRenamed("_row", "row")
    at = df.columns.index(text)
    rows = rows.withColumn("row", F.col("row").withField(f"c{at}", F.col(f"row.c{at}").cast("string")))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(tidy(_stats(at)), f"row {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


#: ratios that rules may test, as (name, numerator, denominator)
RATIOS = (
    ("symbol_ratio", "n_symbols", "word_chars"), ("dup_line_ratio", "n_dup_lines", "n_lines"), ("repeat_ratio", "n_repeat_words", "n_words"), ("word_length", "word_chars", "n_words"),
    ("upper_ratio", "n_upper", "n_letters"), ("digit_ratio", "n_digits", "n_chars_all"), ("bang_ratio", "n_bangs", "n_words"), ("bar_ratio", "n_bars", "n_words"),
)
FEATURES = tuple(r[0] for r in RATIOS) + ("n_words",)


def features() -> dict[str, Column]:
    out = {name: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0)) for name, n, d in RATIOS}
    return out | {"n_words": F.col("n_words").cast("double")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  #: value >= cut, else value < cut
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.above else x[self.feature] < self.cut

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= F.lit(self.cut) if self.above else value < F.lit(self.cut)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    verdict: bool  #: kept

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def _take(x, rows):
    return {k: v[rows] for k, v in x.items()}


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    """Add the condition of best FOIL gain until no row of the other class is covered."""
    chosen: list[Condition] = []
    covered = np.ones(len(y), bool)
    while len(chosen) < MOST_CONDITIONS:
        p, n = int(y[covered].sum()), int((~y[covered]).sum())
        if not p or not n:
            break
        now, best, pick = np.log2(p / (p + n)), 1e-9, None
        for f in FEATURES:
            v = x[f][covered]
            u = np.unique(v)
            for cut in u[np.unique(np.linspace(0, len(u) - 1, CUTS + 1).round().astype(int))[1:]].tolist():
                hit = v >= cut
                for above in (True, False):
                    took = hit if above else ~hit
                    p1 = int(y[covered][took].sum())
                    n1 = int(took.sum()) - p1
                    if p1 < 3:
                        continue
                    gain = p1 * (np.log2(p1 / (p1 + n1)) - now)
                    if gain > best:
                        best, pick = gain, Condition(f, above, cut)
        if pick is None:
            break
        chosen.append(pick)
        covered &= pick.holds(x)
    return chosen


def _prune(conditions: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    """Drop final conditions while (p - n) / (p + n) on the pruning rows doesn't fall."""

    def worth(part):
        hit = np.logical_and.reduce([c.holds(x) for c in part])
        p, n = int((y & hit).sum()), int((~y & hit).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best, score = conditions, worth(conditions)
    for k in range(len(conditions) - 1, 0, -1):
        if (s := worth(conditions[:k])) >= score:
            best, score = conditions[:k], s
    return best


def learn(x: dict[str, np.ndarray], reject: np.ndarray, turn: np.ndarray) -> list[Rule]:
    """Ordered rules that reject; turn: a number per row that decides its third (0: pruning rows)."""
    rules: list[Rule] = []
    left = np.ones(len(reject), bool)
    while (reject & left).sum() >= MIN_COVER:
        grow, prune = left & (turn % 3 != 0), left & (turn % 3 == 0)
        conditions = _grow(_take(x, grow), reject[grow])
        if not conditions:
            break
        if prune.any():
            conditions = _prune(conditions, _take(x, prune), reject[prune])
        rule = Rule(tuple(conditions), False)
        hit = rule.covers(x) & left
        if hit.sum() < MIN_COVER or reject[hit].mean() < MIN_PRECISION:
            break
        held = hit & prune
        if held.any() and reject[held].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression; rows that no rule covers are kept."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(rules[0].verdict))
    for rule in rules[1:]:
        out = out.when(rule.column(), F.lit(rule.verdict))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    """The fixed base rules: under 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = FIT_ROWS) -> list[Rule]:
    """Rules from labelled rows that pass the base rules; label 0 is what rules should reject."""
    marked = pick(labels, key=key, label=label).withColumn("label", F.col("label").cast("int")).where("key IS NOT NULL AND label IN (0, 1)")
    marked = marked.withColumn("h", F.xxhash64(F.col("key").cast("string"))).orderBy("h", "key", "label").limit(bound)  # bounded, so it may be sent to every task
    rows = pick(df, key=key, text=text).join(F.broadcast(marked.select("key").distinct()), "key", "left_semi")
    stats = text_stats(rows, "text").withColumn("key", F.col("row.c0")).join(F.broadcast(marked), "key").where(~base_failed())
    table = stats.select("h", "label", *[c.alias(f) for f, c in features().items()]).orderBy("h", *FEATURES).limit(2 * bound).toPandas()
    if table.empty:
        return []
    x = {f: table[f].to_numpy(np.float64) for f in FEATURES}
    return learn(x, table["label"].to_numpy() == 0, np.abs(table["h"].to_numpy()))


def judge(df: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, COUNTS, base_failed, kept) for every row."""
    out = text_stats(pick(df, key=key, text=text), "text").withColumn("base_failed", base_failed())
    return out.select(F.col("row.c0").alias(key), *COUNTS, "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def with_verdict(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The columns of df and `kept` (which replaces a column of that name)."""
    return text_stats(df, text).withColumnRenamed("row", "_row").select(*restored(df, {"kept": ~base_failed() & verdict(rules)}))
