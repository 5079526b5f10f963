"""A small set of documents with every awkward case, and plain versions of the operators."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def documents(seed=5, n=120):
    """(doc_id, text, lang, source, n_chars): near and exact copies, shared passages, nulls, empty, one word, long, odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([3, 4, 5, 6, 30, 60, 200]))
        text = " ".join(words)
        if i % 9 == 0:
            text += " " + passage
        if i % 4 == 0:
            text = text.replace(" ", "\n", 2) + "\nAll rights reserved 2019."
        texts.append(text)
    for k in range(40):  # near copies of three texts of different lengths
        words = texts[[6, 7, 11][k % 3]].split(" ")
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[2]] * 6 + [texts[6]] * 3 + [texts[3].upper(), texts[3].replace(" ", " \t\n ")]
    texts += [None, None, "", "   \n\t ", "one", "one", "Ünïcödé ÄÖÜ “quotes” 漢字 かな", "a\x1cb c\x85d e", "x" * 5000, " ".join(vocabulary * 30), "<|endoftext|> and <|endoftext|>", "12345 !!! ???"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None]), len(t) if t else None) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, texts[1], "en", "src0", 1), (None, "a text that no other row has at all", "en", "src0", 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, clash=True):
    """The documents, with extra columns whose names operators use inside."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if clash:
        for name in ("key", "TEXT", "row", "n_words", "fp", "_row", "kept", "class", "drops", "label", "id", "c0", "lines_dropped", "tokens", "_word", "probability"):
            df = df.select("*", F.lit("x").alias(name))
    return df


def shingles(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """doc row number -> (n_shingles, component) by comparing all pairs of different sets."""
    sets = [frozenset(shingles(t)) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b:
                k = len(a & b)
                if 100 * k >= 80 * (len(a) + len(b) - k):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def stats(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    marked = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(marked)
