"""Line dedup with a log-template tree of fixed depth.

A line's path in the tree is its token count and its first DEPTH tokens; tokens that hold a digit, an address or a
link are variable fields and read `<*>` on the path.  Leaves that too few different documents reach are cut at once,
by hashes alone.  In a leaf that stays, its most frequent line (variable fields masked) is the leaf's template; lines
that agree with it in SIMILAR or more of their positions join it, and positions that disagree become variable.  The
most frequent line that is left makes the next template, and so on until too few texts are left in the leaf; lines left
then keep a template of their own.  A template is recurring when MIN_DOCS or more different documents have it; one of
LONG or more tokens, which different texts don't share by chance, when LONG_DOCS or more have it.

Every line of a recurring template is dropped, except in the first document that has the template (keep_first):
boilerplate and repeated passages then stay once in the corpus.  Documents with equal texts count as one document, so
copies neither make their lines recur nor stop being copies of each other.

Defined results: a null text stays null; a document left without any line has the empty text; lines without a token
are always kept; of lines equally frequent in a leaf the smaller one becomes the template, and a line near several
templates joins the first made; of documents that have a template the one with the smallest id is first (null ids
come before all); repeated rows are treated alike; a very long text is split into lines inside the JVM, and a line is
one value, so a task needs some times the longest text; extra columns are carried through untouched.

All steps are DataFrame functions; counts are pre-aggregated, and joins are on hashes that Spark may split when one
of them is very frequent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selection import numbered
from .carry import carried, restored
from .keys import maybe_in
from .store import discard, saved

DEPTH = 3
SIMILAR = 0.7
MIN_DOCS = 5
LONG = 8
LONG_DOCS = 2
PAIRED = 24  #: tokens of the longest lines that are compared by pairs of blocks
FEW = 64  #: lines of a key that are all compared with each other
_FIELD = r"[^ \t\n\x0B\f\r]*(?:[0-9]|@|://)[^ \t\n\x0B\f\r]*"
_SPACE = r"[ \t\n\x0B\f\r]+"


def masked(line: Column) -> Column:
    """The line with single spaces and its variable fields as <*>."""
    spaced = F.trim(F.regexp_replace(line, _SPACE, " "))
    return F.when(F.regexp_like(spaced, F.lit("[0-9@]|://")), F.regexp_replace(spaced, _FIELD, "<*>")).otherwise(spaced)


def _tokens() -> Column:
    return F.split(F.col("line"), " ")


def lines_of(df: DataFrame) -> DataFrame:
    """(id, class, pos, line, leaf, long, hash) for each line that has a token."""
    exploded = df.select("id", "class", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).where(F.regexp_like("raw", F.lit(r"[^ \t\n\x0B\f\r]")))
    return exploded.select("id", "class", "pos", masked(F.col("raw")).alias("line")).select(
        "id", "class", "pos", "line", F.xxhash64(F.size(_tokens()), F.substring_index("line", " ", DEPTH)).alias("leaf"), (F.size(_tokens()) >= LONG).alias("long"), F.xxhash64("line").alias("hash")
    )


def _agreeing(a: Column, b: Column, similar: float) -> Column:
    """Whether two arrays of tokens agree in enough positions."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return same / F.size(a) >= similar


def _keys(size: Column, tokens: Column, similar: float) -> Column:
    """Hashes of parts of a line, of which two lines of a leaf that agree in enough positions share at least one.

    They differ in `most` positions at most, none of them among the first DEPTH.  Of most + 2 blocks of the other positions two are
    equal, so pairs of blocks are keys; long lines have single ones of most + 1 blocks, which are long enough themselves.
    """
    most = F.floor(size * (1 - similar) + 1e-6).cast("int")
    count = most + F.when(size <= PAIRED, 2).otherwise(1)
    start = lambda k: F.floor(k * (size - DEPTH) / count).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.xxhash64(F.slice(tokens, start(k) + DEPTH + 1, start(k + 1) - start(k))))
    paired = F.flatten(F.transform(blocks, lambda x, i: F.transform(F.slice(blocks, i + 2, count), lambda y, j: F.xxhash64(i, j, x, y))))
    return F.when(size <= PAIRED, paired).otherwise(F.transform(blocks, lambda x, i: F.xxhash64(i, x)))


def further(left: DataFrame, hashes: DataFrame, least: Column, similar: float) -> DataFrame | None:
    """(leaf, hash, template) of the lines of `left` that join a further template of their leaf or make one that others join.

    left: (leaf, long, hash, line, many), a saved table of lines that joined none.  Lines are numbered in the order in
    which they become templates.  Lines that agree share a key.  A line that waits for none before it is a template: where
    a key has few lines it waits for those that it agrees with, where it has many for the first of them that is open.
    Each round finds the templates there are, and the lines that agree with them are no longer open, but may still find a
    template that comes before theirs.  That gives the templates of one line at a time; work follows the lines, not their pairs.
    """
    seen = saved(maybe_in(hashes, "hash", left).where("_maybe").join(left.select("leaf", "hash"), ["leaf", "hash"]).groupBy("leaf", "long").agg(F.countDistinct("class").alias("docs")).where(least).select("leaf"), "left-leaves")
    if seen.isEmpty():
        return None
    order = numbered(left.join(seen, "leaf").select("leaf", "hash", "line", (-F.col("many")).alias("less")), ["less", "line", "leaf"])
    lines = saved(order.select("n", "leaf", "hash", F.split("line", " ").alias("tokens")), "numbered-lines")
    keys = lines.select("n", "leaf", F.explode(_keys(F.size("tokens"), F.col("tokens"), similar)).alias("key")).select("n", F.xxhash64("leaf", "key").alias("key"))
    keys = saved(keys, "keys")
    many = saved(keys.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1"), "shared-keys")

    def packed(df: DataFrame, label: str) -> DataFrame:
        """Saved in files of a task's size, however few: rounds read these tables again and again."""
        return saved(df.hint("rebalance"), label)

    def agreeing(met: DataFrame) -> DataFrame:
        """met (n, head) of lines that share a key -> those that agree."""
        pair = met.join(lines.select("n", "tokens"), "n").join(lines.select(F.col("n").alias("head"), F.col("tokens").alias("other")), "head")
        return pair.where(_agreeing(F.col("tokens"), F.col("other"), similar)).select("n", "head")

    # Lines of a key with few of them are compared at once: at most FEW for each line and key.
    few = keys.join(many.where(F.col("lines") <= FEW), "key").drop("lines")
    edges = packed(agreeing(few.join(few.withColumnRenamed("n", "head"), "key").where("head < n").select("n", "head").distinct()), "edges")
    big = packed(keys.join(many.where(F.col("lines") > FEW), "key").drop("lines"), "big-keys")
    open_ = packed(edges.select("n").union(edges.select("head")).union(big.select("n")).distinct().withColumn("best", F.lit(None).cast("long")), "open")
    found: list[DataFrame] = []
    while True:
        # A line waits for those before it that it agrees with, and under a key with many lines for the first open one.
        free = open_.where("best IS NULL").select("n")
        first = big.join(free, "n").groupBy("key").agg(F.min("n").alias("first"))
        waiting = edges.join(free, "n").join(free.withColumnRenamed("n", "head"), "head").select("n").union(big.join(free, "n").join(first, "key").where("first < n").select("n"))
        heads = packed(free.join(waiting.distinct(), "n", "left_anti").select(F.col("n").alias("head")), "heads")
        if heads.isEmpty():
            return reduce(DataFrame.unionByName, found).groupBy("n").agg(F.min("head").alias("head")).transform(lambda t: _named(t, lines)) if found else None
        near = big.join(heads.withColumnRenamed("head", "n"), "n").select("key", F.col("n").alias("head")).join(big, "key").where("head < n").select("n", "head").join(open_, "n").where("best IS NULL OR head < best")
        taken = packed(edges.join(heads, "head").select("n", "head").union(agreeing(near.select("n", "head").distinct())).groupBy("n").agg(F.min("head").alias("head")), "taken")
        found.append(taken)
        still = packed(open_.join(heads, F.col("n") == F.col("head"), "left_anti").join(taken, "n", "left").select("n", F.least("best", "head").alias("best")), "open")
        discard(open_, heads)
        open_ = still


def _named(taken: DataFrame, lines: DataFrame) -> DataFrame:
    """(leaf, hash, template) of the lines that were taken, and of the templates that took them."""
    names = lines.select("n", "leaf", "hash")
    members = taken.join(names, "n").join(names.select(F.col("n").alias("head"), F.col("hash").alias("template")), "head").select("leaf", "hash", "template")
    own = names.join(taken.select(F.col("head").alias("n")).distinct(), "n").select("leaf", "hash", F.col("hash").alias("template"))
    return members.unionByName(own)


def recurring(lines: DataFrame, hashes: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR, long_docs: int = LONG_DOCS) -> DataFrame:
    """(leaf, hash, template, docs, first) for each line whose template recurs; first: the class of its first document.

    hashes: `lines` without the line itself, as a saved table.
    """
    enough = F.col("docs") >= F.when(F.col("long"), long_docs).otherwise(min_docs)
    slim = hashes.select("leaf", "long", "class").distinct()
    leaves = saved(slim.groupBy("leaf", "long").agg(F.count("*").alias("docs")).where(enough).select("leaf"), "leaves")
    # Lines are counted before they meet their leaf, so that a leaf with a very frequent line has it as one row.
    reached = maybe_in(lines, "leaf", leaves).where("_maybe").groupBy("leaf", "long", "hash").agg(F.min("line").alias("line"), F.count("*").alias("many"))
    distinct = saved(reached.join(leaves, "leaf", "left_semi"), "lines")
    # The leaf's template line: most frequent, then smallest.
    main = distinct.groupBy("leaf").agg(F.min(F.struct((-F.col("many")).alias("less"), "line")).alias("m")).select("leaf", F.col("m.line").alias("main"))
    agree = F.expr("aggregate(zip_with(split(line, ' '), split(main, ' '), (a, b) -> CASE WHEN a = b THEN 1 ELSE 0 END), 0, (s, x) -> s + x) / size(split(line, ' '))")
    joined = distinct.join(main, "leaf").withColumn("template", F.when(agree >= similar, F.xxhash64("main")))
    joined = saved(joined.drop("main"), "joined")
    left = saved(joined.where("template IS NULL").drop("template"), "left")
    # A line that no further template takes is alone: its hash is its template.
    found = further(left, hashes, enough, similar)
    if found:
        later = found.withColumnRenamed("template", "later")
        joined = joined.join(later, ["leaf", "hash"], "left").withColumn("template", F.coalesce("template", "later"))
    grouped = saved(joined.select("leaf", "hash", F.coalesce("template", "hash").alias("template")), "templates")
    used = hashes.join(grouped, ["leaf", "hash"])
    per = used.groupBy("leaf", "long", "template", "class").agg(F.min("id").alias("id")).groupBy("leaf", "long", "template").agg(F.count("*").alias("docs"), F.min(F.struct("id", "class")).alias("f"))
    kept = per.where(enough).select("leaf", "template", "docs", F.col("f.class").alias("first"))
    return grouped.join(kept, ["leaf", "template"]).select("leaf", "hash", "template", "docs", "first")


def _without(lines: Column, drops: Column) -> Column:
    """The lines at places that are not in `drops`, as a text; places come from one set difference."""
    both = F.array(F.struct(lines.alias("x"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops).alias("at")))
    return F.transform(both, lambda b: F.array_join(F.transform(b["at"], lambda i: F.get(b["x"], i)), "\n"))[0]


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, keep_first: bool = True, long_docs: int = LONG_DOCS) -> DataFrame:
    """df with the text column's recurring lines dropped, plus lines_dropped (int, replacing a column of that name)."""
    marked = carried(df, apart=text, id=key, text=text).withColumn("text", F.col("text").cast("string")).withColumn("class", F.unhex(F.md5(F.col("text").cast("binary"))))
    lines = lines_of(marked.select("id", "class", "text").where("text IS NOT NULL"))
    hashes = saved(lines.drop("line"), "hashes")
    again = saved(recurring(lines, hashes, min_docs, long_docs=long_docs), "recurring")
    hit = hashes.join(again, ["leaf", "hash"])
    if keep_first:
        hit = hit.where("class <> first")
    # Equal texts have equal lines at equal places, so drops are gathered per class, once for all its copies.
    drops = saved(hit.select("class", "pos").distinct().groupBy("class").agg(F.collect_list("pos").alias("drops")), "drops")
    # Texts without drops don't move; the others merge with their drops, whatever the number of these.
    told = maybe_in(marked, "class", drops, "_hit")
    still = told.where("NOT _hit").withColumn("drops", F.lit(None).cast("array<int>"))
    out = still.unionByName(told.where("_hit").join(drops.hint("merge"), "class", "left"))
    # Places that stay come from one set difference, whose cost follows the number of lines.
    left = _without(F.split("text", "\n"), F.col("drops"))
    return out.select(*restored(df, {text: F.when(F.col("drops").isNull() | F.col("text").isNull(), F.col("text")).otherwise(left), "lines_dropped": F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops"))}))


def sql(crc: str, crc_table: str, min_docs: int = MIN_DOCS, similar: float = SIMILAR, depth: int = DEPTH, long: int = LONG, long_docs: int = LONG_DOCS) -> str:
    """One template of each leaf at a time, as the docstring tells it."""
    field, space = _FIELD, _SPACE
    enough = f"CASE WHEN len(any_value(tok)) >= {long} THEN {long_docs} ELSE {min_docs} END"
    return rf"""
WITH RECURSIVE {crc_table},
d AS (SELECT text, min(doc_id) AS id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text),
r AS (SELECT id, copies, generate_subscripts(s, 1) AS pos, unnest(s) AS raw FROM (SELECT id, copies, string_split(text, chr(10)) AS s FROM d)),
m AS (SELECT id, copies, pos, regexp_replace(trim(regexp_replace(raw, '{space}', ' ', 'g')), '{field}', '<*>', 'g') AS line FROM r WHERE regexp_matches(raw, '[^ \t\n\x0B\f\r]')),
t AS (SELECT id, copies, pos, line, string_split(line, ' ') AS tok FROM m),
l AS (SELECT *, len(tok) || ' ' || array_to_string(tok[1:{depth}], ' ') AS leaf FROM t),
k AS (SELECT leaf FROM l GROUP BY leaf HAVING count(DISTINCT id) >= {enough}),
c AS MATERIALIZED (SELECT l.* FROM l JOIN k USING (leaf)),
g AS MATERIALIZED (SELECT leaf, line, tok, sum(copies) AS many FROM c GROUP BY ALL),
turn(leaf, line, tok, many, template) AS (
  SELECT leaf, line, tok, many, NULL::VARCHAR FROM g
  UNION ALL
  SELECT leaf, line, tok, many, CASE WHEN len(list_filter(range(1, len(tok) + 1), lambda i: tok[i] = main[i])) / len(tok)::DOUBLE >= {similar} THEN array_to_string(main, ' ') END
  FROM (SELECT *, first_value(tok) OVER (PARTITION BY leaf ORDER BY many DESC, line) AS main FROM turn WHERE template IS NULL)),
p AS MATERIALIZED (SELECT leaf, line, template FROM turn WHERE template IS NOT NULL),
a AS (SELECT leaf, template, min(id) AS first FROM c JOIN p USING (leaf, line) GROUP BY ALL HAVING count(DISTINCT id) >= {enough}),
h AS (SELECT DISTINCT c.id, c.pos FROM c JOIN p USING (leaf, line) JOIN a USING (leaf, template) WHERE c.id <> a.first),
o AS (SELECT r.id, count(h.pos)::INTEGER AS dropped, coalesce(string_agg(r.raw, chr(10) ORDER BY r.pos) FILTER (h.pos IS NULL), '') AS text FROM r LEFT JOIN h USING (id, pos) GROUP BY r.id),
f AS (SELECT x.doc_id, coalesce(o.dropped, 0) AS lines_dropped, CASE WHEN o.dropped > 0 THEN o.text ELSE x.text END AS text FROM documents x LEFT JOIN d ON x.text = d.text LEFT JOIN o ON o.id = d.id)
SELECT doc_id, lines_dropped::INTEGER AS lines_dropped, strlen(text)::BIGINT AS n_bytes, {crc} AS text_crc32 FROM f CROSS JOIN crc_table
"""
