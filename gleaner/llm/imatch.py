"""I-Match fingerprints: a hash of each randomised subset of the lexicon, over the text's terms in that subset.

The lexicon is the terms of an inverse-document-frequency band.  A text keeps its distinct terms of the lexicon, sorted,
and every lexicon subset hashes those that it holds.  Texts with the same terms in a subset share its hash, so a changed
term spoils only the subsets that it is in.  LEVELS gives the subsets: the whole lexicon (the classical single fingerprint), then
random parts of ever smaller shares of it, because long texts need sparse parts to agree anywhere and short ones dense
parts to be in any.  A text without a term of the lexicon has its distinct terms hashed as a whole, and no other hash.

Terms are runs of characters other than ASCII punctuation, space and control characters, A-Z lower-cased.  They are
handled by a 60-bit code of their MD5, by which they are sorted and whose bits deal them out to subsets.

A term is in the lexicon if it is in at least one of RARE documents and at most one of COMMON.  So there are at most RARE
times as many terms as the mean document has distinct ones, whatever the corpus: up to HELD_TERMS they go to every task,
beyond it the join shuffles.

Defined results: null and empty texts, and those without a term, have the hash of no terms (EMPTY) in every subset, are
like each other (1.0) and unlike all others; repeated rows are each returned; of rows with one key any may be next; a null
key comes before all others; a very long text is split whole, inside the JVM; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import pick
from .store import saved

COMMON, RARE = 2, 2000  #: idf from ln 2 to ln 2000
HELD_TERMS = 1_000_000
#: (a subset's share of the lexicon is one in this, number of subsets, first bit of the code that deals out the terms)
LEVELS = [(1, 1, 0), (4, 4, 0), (4, 4, 2), (16, 16, 4), (64, 16, 8), (256, 16, 14), (1024, 16, 22)]
ENOUGH = 8  #: filled subsets of a level that make its likeness count
RANGES = 12  #: ranges of keys for each shuffle partition; more of them make partitions more even
EMPTY = "d41d8cd9"  #: begin of the MD5 of nothing
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.array_remove(F.split(F.translate(text, UPPER, LOWER), BREAKS), ""))


def code(term: Column) -> Column:
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 15), 16, 10).cast("long")


def lexicon(texts: DataFrame, common: int = COMMON, rare: int = RARE) -> DataFrame:
    """texts (text) -> (term, code) of the band, as a saved table."""
    met = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = met.crossJoin(F.broadcast(texts.agg(F.count("*").alias("n")))).where((F.col("df") * common <= F.col("n")) & (F.col("df") * rare >= F.col("n")))
    return saved(kept.select("term", code(F.col("term")).alias("code")), "lexicon")


def _hashed(codes: Column) -> Column:
    return F.substring(F.md5(F.array_join(codes.cast("array<string>"), " ").cast("binary")), 1, 8)


def _dealt(codes: str, bit: int, share: int, to: Callable[[Column], Column]) -> Column:
    """The codes whose number among the level's subsets `to` takes."""
    return F.filter(codes, lambda c: to(F.shiftright(c, bit).bitwiseAND(F.lit(share - 1))))


def _subsets(rows: DataFrame, codes: str, whole: Column, out: str) -> DataFrame:
    """rows with the hashes of all subsets, an array, from a column of sorted codes; whole: the first one if there are no codes."""
    at_hand: list[Column] = []
    for k, (share, parts, bit) in enumerate(LEVELS):
        if share == 1:
            at_hand.append(F.when(F.size(codes) > 0, _hashed(F.col(codes))).otherwise(F.substring(whole, 1, 8)))
            continue

        if parts < share:  # most codes are in none of this level's subsets
            rows = rows.withColumn(f"_level{k}", _dealt(codes, bit, share, lambda d, parts=parts: d < parts))
        own = f"_level{k}" if parts < share else codes
        at_hand += [_hashed(_dealt(own, bit, share, lambda d, j=j: d == j)) for j in range(parts)]
    return rows.withColumn(out, F.array(*at_hand)).drop(*[f"_level{k}" for k in range(len(LEVELS))])


def fingerprints(rows: DataFrame, row: list[str], texts: list[str], lex: DataFrame, keep: list[str] = []) -> DataFrame:
    """The columns `row`, which tell rows apart, and `keep`, and the subset hashes of each text column (as `<column>_hashes`).

    Where rows are already dealt out by one of the columns `row` and the lexicon goes to every task, nothing is shuffled.
    """
    if lex.limit(HELD_TERMS + 1).count() <= HELD_TERMS:
        lex = F.broadcast(lex)
    none = F.array().cast("array<string>")
    split = rows.select(*row, *keep, *[terms(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(texts)])
    about = F.struct(*keep, *[F.md5(F.array_join(F.sort_array(f"t{i}"), " ").cast("binary")).alias(f"whole{i}") for i in range(len(texts))])
    # One row carries what is known of the text, the others have a term only.
    parts = [F.struct(F.lit(-1).alias("k"), F.array(F.lit("")).alias("terms"), about.alias("about"))]
    parts += [F.struct(F.lit(i).alias("k"), F.coalesce(F.col(f"t{i}"), none).alias("terms"), F.lit(None).cast(split.select(about.alias("a")).schema["a"].dataType).alias("about")) for i in range(len(texts))]
    met = split.select(*row, F.explode(F.array(*parts)).alias("x")).select(*row, F.col("x.k").alias("k"), F.col("x.about").alias("about"), F.explode("x.terms").alias("term"))
    met = met.join(lex, "term", "left").where("k < 0 OR code IS NOT NULL").select(*row, "k", "about", "code")
    lists = [F.sort_array(F.collect_list(F.when(F.col("k") == i, F.col("code")))).alias(f"c{i}") for i in range(len(texts))]
    out = met.groupBy(*row).agg(F.first("about", ignorenulls=True).alias("about"), *lists).select(*row, "about.*", *[f"c{i}" for i in range(len(texts))])
    for i, c in enumerate(texts):
        out = _subsets(out, f"c{i}", F.col(f"whole{i}"), f"{c}_hashes")
    return out.select(*row, *keep, *[f"{c}_hashes" for c in texts])


def fingerprint(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either text fills, at the sparsest level with ENOUGH of them, else the densest sampled one."""
    pairs, at = F.arrays_zip(a.alias("a"), b.alias("b")), 1
    shares = []
    for share in sorted({s for s, _, _ in LEVELS}):
        n = sum(parts for s, parts, _ in LEVELS if s == share)
        filled = F.filter(F.slice(pairs, at, n), lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
        same = F.size(F.filter(F.slice(pairs, at, n), lambda p: (p["a"] == p["b"]) & (p["a"] != EMPTY)))
        shares.append((F.size(filled), same / F.size(filled)))
        at += n
    whole, densest, *sparser = shares
    return F.coalesce(*[F.when(n >= ENOUGH, x) for n, x in reversed(sparser)], F.when(densest[0] > 0, densest[1]), F.when(whole[0] > 0, whole[1]), F.lit(1.0))


def _below(key: Column, bounds: list, within) -> Column:
    """How many of the sorted bounds the key is beyond, in two steps of about their square root."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = F.size(F.filter(F.lit(bounds[::step]), lambda b: within(b, key)))
    inside = F.size(F.filter(F.slice(F.lit(bounds), F.greatest(blocks - 1, F.lit(0)) * step + 1, step), lambda b: within(b, key)))
    return F.when(blocks == 0, 0).otherwise((blocks - 1) * step + inside)


def _in_range():
    return Window.partitionBy("_range").orderBy("_extra", "key", "tie")


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (key, tie, columns) with `next`, a struct of these columns in the next row by key; after the last row, the first.

    The result is dealt out by `_range`.  It holds the first row of the next range, too, marked by `_extra` = 1 and without a
    next, so that what is made of the columns can be had of the next row by `lead` over _in_range(), without another shuffle.

    Keys (numbers) are cut into ranges at their quantiles and each range is ordered in one task, so rows move once; a key
    that fills several ranges is dealt out among them by `tie`.
    """
    parts = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("key", F.lit([i / parts for i in range(1, parts)]), 10 * parts).alias("b")).collect()[0]["b"]
    if not found:
        found = [0]
    first_range, last_range = _below(F.col("key"), found, lambda b, k: b < k), _below(F.col("key"), found, lambda b, k: b <= k)
    placed = rows.withColumn("_low", first_range).withColumn("_high", last_range)
    placed = placed.withColumn("_range", F.when(F.col("key").isNull(), 0).otherwise(F.col("_low") + F.pmod("tie", F.col("_high") - F.col("_low") + 1)).cast("int")).drop("_low", "_high")
    firsts = saved(placed.groupBy("_range").agg(F.min(F.struct("key", "tie")).alias("f")), "range-firsts")  # one row a range
    before = F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.max("_range").over(Window.partitionBy()))
    firsts = F.broadcast(firsts.select(F.col("_range").alias("_r"), "f", before.alias("_before")))
    again = placed.join(firsts, (F.col("_range") == F.col("_r")) & F.col("key").eqNullSafe(F.col("f.key")) & (F.col("tie") == F.col("f.tie")))
    again = again.withColumn("_range", F.col("_before")).select(*placed.columns).dropDuplicates(["_range"]).withColumn("_extra", F.lit(1))
    both = placed.withColumn("_extra", F.lit(0)).unionByName(again)
    return both.withColumn("next", F.lead(F.struct(*columns)).over(_in_range()))


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    A text's edited form has the last half of its characters replaced by as many of the next document's first ones.
    """
    rows = pick(df, key=key, text=text).select("key", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lex = lexicon(rows.select("text"))
    ordered = with_next(rows.withColumn("tie", F.xxhash64("text")), ["text"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    ordered = ordered.select("_range", "_extra", "key", "tie", "text", F.length("text").cast("long").alias("n_chars"), F.coalesce(edited, F.lit("")).alias("edited"), F.monotonically_increasing_id().alias("row"))
    ordered = ordered.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    made = fingerprints(ordered, ["_range", "row"], ["text", "edited"], lex, ["_extra", "key", "tie", "n_chars", "edited_sha256"])
    met = made.withColumn("next_hashes", F.lead("text_hashes").over(_in_range())).where("_extra = 0")
    return met.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", fingerprint(F.col("text_hashes")).alias("fingerprint"), fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("text_hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("text_hashes"), F.col("next_hashes")).alias("near_next"),
    )


def sql(common: int = COMMON, rare: int = RARE) -> str:
    """The same of `documents`, for keys without repeats."""

    def words(text: str) -> str:
        return f"list_distinct(list_filter(string_split_regex(translate({text}, '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda w: w <> ''))"

    def hashes(name: str) -> str:
        def one(codes: str) -> str:
            return f"substr(md5(array_to_string({codes}, ' ')), 1, 8)"

        out = [f"CASE WHEN len({name}_c) > 0 THEN {one(name + '_c')} ELSE {name}_w END"]
        for share, parts, bit in LEVELS:
            out += [one(f"list_filter({name}_c, lambda c: (c >> {bit}) & {share - 1} = {j})") for j in range(parts) if share > 1]
        return f"[{', '.join(out)}]"

    def like(a: str, b: str) -> str:
        cases, at = [], 1
        for share in sorted({s for s, _, _ in LEVELS}):
            n = sum(parts for s, parts, _ in LEVELS if s == share)
            filled = f"len(list_filter(range({at}, {at + n}), lambda i: {a}[i] <> '{EMPTY}' OR {b}[i] <> '{EMPTY}'))"
            same = f"len(list_filter(range({at}, {at + n}), lambda i: {a}[i] = {b}[i] AND {a}[i] <> '{EMPTY}'))"
            least = 1 if len(cases) < 2 else ENOUGH
            cases.append(f"WHEN {filled} >= {least} THEN {same} / {filled}")
            at += n
        whole, densest, *sparser = cases
        return f"CASE {' '.join([*reversed(sparser), densest, whole])} ELSE 1.0 END::DOUBLE"

    sides = {"a": "text", "e": "edited"}
    lists = ", ".join(f"{words(c)} AS {s}" for s, c in sides.items())
    kept = ", ".join(f"k{s} AS (SELECT doc_id, list(code ORDER BY code) AS c FROM (SELECT doc_id, unnest({s}) AS term FROM w) JOIN lex USING (term) GROUP BY doc_id)" for s in sides)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nt, length(text) AS n_chars FROM d),
    e AS (SELECT doc_id, n_chars, text, left(text, n_chars - n_chars // 2) || left(nt, n_chars // 2) AS edited FROM n),
    w AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {lists} FROM e),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(a) AS term FROM w) GROUP BY term),
    lex AS (SELECT term, ('0x' || substr(md5(term), 1, 15))::BIGINT AS code FROM df WHERE df * {common} <= (SELECT count(*) FROM d) AND df * {rare} >= (SELECT count(*) FROM d)),
    {kept},
    x AS (SELECT w.doc_id, n_chars, edited_sha256, {", ".join(f"coalesce(k{s}.c, []) AS {s}_c, substr(md5(array_to_string(list_sort({s}), ' ')), 1, 8) AS {s}_w" for s in sides)} FROM w {" ".join(f"LEFT JOIN k{s} ON k{s}.doc_id = w.doc_id" for s in sides)}),
    h AS (SELECT doc_id, n_chars, edited_sha256, {", ".join(f"{hashes(s)} AS {s}" for s in sides)} FROM x),
    y AS (SELECT *, coalesce(lead(a) OVER (ORDER BY doc_id), first_value(a) OVER (ORDER BY doc_id)) AS b FROM h)
    SELECT doc_id, n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint, {like("a", "e")} AS near_edited, {like("a", "b")} AS near_next FROM y"""
