import random
import re
import time
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, documents, frame, stats
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import language_id, line_dedup, mixing, packing, quality_rules, sharding, token_counts
from gleaner.llm.pieces import Pieces
from gleaner.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("hot, held", [(token_counts.HOT, token_counts.HELD), (20, 50), (0, 5)])
def test_token_counts_equal_the_library(spark, library, hot, held, monkeypatch):
    monkeypatch.setattr(token_counts, "HELD", held)
    rows = documents()
    got = token_counts.token_counts(frame(spark).repartition(5), PATH, limit=50, hot=hot).collect()
    want = Counter((r[0], len((r[1] or "").encode()), n := len(ids_of(library, r[1])), n > 50) for r in rows)
    assert Counter(map(tuple, got)) == want
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'’_-stdmrevl0123²½éß<|endoftext|>漢字か\u00a0😀"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_pieces_equal_the_library_on_any_text(texts):
    from tokenizers import Tokenizer

    if not hasattr(test_pieces_equal_the_library_on_any_text, "made"):
        alone = Pieces(PATH)
        alone.ranked = None  # where tiktoken isn't there
        test_pieces_equal_the_library_on_any_text.made = Pieces(PATH), alone, Tokenizer.from_file(PATH)
    made, alone, library = test_pieces_equal_the_library_on_any_text.made
    assert made.byte_level and made.ranked is not None
    for t in texts:
        want = array("I", ids_of(library, t)).tobytes()
        assert made.encoded(t) == want and alone.encoded(t) == want
        assert sum(made.sizes(made.pre_tokens(t))) == len(want) // 4


def test_pieces_of_other_tokenizers():
    """Without the known split a text is one pre-token, and the sums still hold."""
    from pathlib import Path

    from tokenizers import Tokenizer

    for path in sorted(Path(PATH).parent.glob("*.json")):
        made, library = Pieces(str(path)), Tokenizer.from_file(str(path))
        for t in ("Some words, it's 2019.", "漢字 かな a\u00a0b", ""):
            assert sum(made.sizes(made.pre_tokens(t))) == len(library.encode(t, add_special_tokens=False).ids)


def check_packing(rows, got, library, size, end=2):
    want = Counter()
    for r in rows:
        ids = [*ids_of(library, r[1]), end]
        first = len(ids) % size or size
        edges = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[r[0], k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())] += 1
    assert Counter((r[0], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(r["length"] for r in got)


@pytest.mark.parametrize("size", [1024, 64])
def test_packing_round_trip(spark, library, size):
    got = packing.pack(frame(spark).repartition(5), PATH, size=size).collect()
    bins, tokens = check_packing(documents(), got, library, size)
    assert bins <= -(-tokens // size) + 2
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_fullest_combination_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        size = rng.randint(5, 40)
        counts = Counter(rng.randint(1, size) for _ in range(rng.randint(1, 9)))
        items = sorted(counts.elements(), reverse=True)
        best = max(s for m in range(1 << (len(items) - 1)) if (s := items[0] + sum(x for i, x in enumerate(items[1:]) if m >> i & 1)) <= size)
        got = packing.fullest(dict(counts), size)
        assert sum(got) == best and got[0] == items[0] and not Counter(got) - counts
    big = {rng.randint(1, 1024): rng.randint(1, 10**9) for _ in range(300)}
    made = packing.plan(big, 1024)
    used = Counter()
    for use, times in made:
        assert sum(n * k for n, k in use.items()) <= 1024
        for n, k in use.items():
            used[n] += k * times
    assert used == Counter(big)


def test_text_statistics_against_plain_counts(spark):
    rng = random.Random(7)
    texts = ["", None, "a b c a b c", "x\nx\nx\n\n \n", "# $ % <|> & *", "ä ö ü ä ö ü ß", "漢字 かな 漢字", "a  b\tc\x0bd\x0ce\rf", "\x1c \x85 　", "one"] + [" ".join(rng.choices("abc", k=rng.randint(0, 20))) + rng.choice(["", "\n", "\na"]) for _ in range(200)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + documents()[:150]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = quality_rules.judge(df, []).collect()
    want = Counter()
    for r in rows:
        n, chars, symbols, dup, repeat = stats(r[1])
        failed = n < 50 or 100 * repeat > 50 * n
        want[r[0], n, chars, symbols, dup, repeat, failed, not failed] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got) == want


def _noisy(n=400, seed=9):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(80)]
        bad = i % 4 == 0
        if bad:
            words = [w + rng.choice(["###", "$$$"]) for w in words] if i % 8 == 0 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", "src0", 1))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_rules_are_learned_and_emitted_in_order(spark):
    rows, labels = _noisy()
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(docs, marks)
    assert 1 <= len(rules) <= 4
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, rules).collect()}
    assert kept == {i: bool(q) for i, q, _ in labels}
    other = quality_rules.with_verdict(frame(spark), rules)
    assert other.columns == frame(spark).columns and other.count() == len(documents())
    assert dict(other.dtypes)["kept"] == "boolean"
    assert quality_rules.fit(docs, marks.limit(0)) == []
    assert quality_rules.fit(docs.limit(0), marks) == []


def test_language_on_held_out_documents(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.identify(docs.withColumn("lang", F.col("lang"))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()
    hidden = language_id.identify(docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang"))))
    again = hidden.where("held_out").toPandas().set_index("doc_id")["lang_pred"]
    assert (again == got.set_index("doc_id")["lang_pred"].reindex(again.index)).all()


def plain_language(rows, held, mask=0xFFFFFFFF):
    """Naive Bayes in plain Python: row number -> (languages whose total is the best but for rounding, score)."""
    import math

    def grams(text):
        t, out = text.lower(), Counter()
        for n in language_id.ORDERS:
            for i in range(len(t) - n + 1):
                v = n * 0x27D4EB2F & mask
                for k in range(n):
                    v = (v ^ ord(t[i + k])) * language_id._MULTIPLIERS[k] & mask
                    v ^= v >> 15
                out[v % language_id.BUCKETS] += 1
        return out

    counts = {}
    for (_, t, lang, *_), h in zip(rows, held):
        if lang is not None and not h:
            counts.setdefault(lang, Counter()).update(grams(t or ""))
    size = {x: sum(c.values()) + language_id.BUCKETS for x, c in counts.items()}
    out = []
    for _, t, *_ in rows:
        if not any(map(str.isalpha, t or "")) or not counts:
            out.append(({"und"}, 0.0))
            continue
        total = {x: sum(k * math.log((c[b] + 1) / size[x]) for b, k in grams(t).items()) for x, c in sorted(counts.items())}
        best = max(total, key=lambda x: (total[x], [-ord(c) for c in x]))
        out.append(({x for x, v in total.items() if total[best] - v <= 1e-9}, 1 / sum(math.exp(min(0, v - total[best])) for v in total.values())))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_language_against_plain_bayes(spark, monkeypatch, piece):
    """In one process, so that the length of a piece reaches the functions."""
    monkeypatch.setattr(language_id, "PIECE", piece)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"{x}{k}{y}" for k in "aeiou" for x, y in ("bd", "ñt", "sß")], k=rng.randint(0, 9))), f"l{i % 90:03}" if i < 200 else None, None, 1) for i in range(230)]
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
    shape = [(r[1], r[2]) for r, h in zip(rows, held) if r[2] is not None and not h]
    assert len({x for _, x in shape}) > language_id.LANGUAGES
    import pyarrow as pa

    batch = pa.record_batch([pa.array([t for t, _ in shape]), pa.array([x for _, x in shape])], ["text", "lang"])
    langs = sorted({x for _, x in shape})
    n = {}
    for part in language_id._train([batch]):
        for lang, bucket, count in zip(*(part.column(c).to_pylist() for c in ("lang", "bucket", "n"))):
            n[lang, bucket] = n.get((lang, bucket), 0) + count
    matrix = language_id.matrix(n, langs)
    inner = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(held)], ["key", "text", "held_out"])
    got = [x for part in language_id._predict(type("Shared", (), {"value": (langs, matrix)}))([inner]) for x in part.to_pylist()]
    told = plain_language(rows, held)
    for g, (best, score) in zip(got, told, strict=True):
        assert abs(g["score"] - score) < 1e-9
        assert g["lang_pred"] in best
    assert sum(len(best) == 1 for best, _ in told) > 150


@pytest.mark.parametrize("key", [None, 7])
def test_language_bound_holds_for_rows_of_one_key(spark, key):
    rows = [(key, f"{chr(0x4E00 + i) * 6} word", f"l{i:03}") for i in range(200)]
    langs, _ = language_id.train(spark.createDataFrame(rows, "key long, text string, lang string"), 10)
    assert len(langs) == 10
    langs, _ = language_id.train(spark.createDataFrame(rows[:1] * 100 + rows[1:5], "key long, text string, lang string"), 1000)
    assert len(langs) == 5


def test_all_languages_are_learnt(spark):
    rows = [(i, f"{chr(0x4E00 + i % 300) * 6} word", f"l{i % 300:03}", None, 1) for i in range(1200)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 1180  # a few share a bucket with others


def test_language_of_awkward_texts(spark):
    rows = documents()
    got = language_id.identify(frame(spark).repartition(4)).collect()
    assert len(got) == len(rows)
    letters = {r[0]: any(map(str.isalpha, r[1] or "")) for r in rows}
    for r in got:
        assert (r["lang_pred"] == "und") == (not letters[r["doc_id"]]) or r["doc_id"] is None
        assert 0 <= r["score"] <= 1 and (r["doc_id"] is not None or not r["held_out"])
        assert r["lang_pred"] in ("en", "de", "und")
    unlabelled = frame(spark, clash=False).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_templates(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        own = " ".join("".join(rng.choices("qwertz", k=6)) for _ in range(8))
        lines = [own, f"Page {i} of 30 printed on {i}.{i}.2020"]
        if i % 2:
            lines.append("Read more at http://example.org/%d now please" % i)
        if i < 4:
            lines.append("only four documents have this line here")
        lines += ["", "  "]
        rows.append((i, "\n".join(lines), "en", "src0", 1))
    rows += [(40 + k, rows[3][1], "en", "src0", 1) for k in range(3)] + [(50, None, None, None, None), (51, "", None, None, 0), (None, "unique line of no id", None, None, 1)]
    df = frame(spark, rows).repartition(4)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = {r[0]: (r[1], r[out.columns.index("lines_dropped")]) for r in out.collect()}
    assert got[0] == (rows[0][1], 0)  # the first document of every template
    for i in range(1, 30):
        lines = rows[i][1].split("\n")
        gone = {1} | ({2} if i % 2 and i > 1 else set())
        assert got[i] == ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)), i
    assert got[40] == got[41] == got[42] == got[3]  # copies stay copies
    assert got[50] == (None, 0) and got[51] == ("", 0) and got[None] == ("unique line of no id", 0)
    none = next(r[1] for r in line_dedup.dedup_lines(df, keep_first=False).collect() if r[0] == 0)
    assert none.split("\n")[0] == rows[0][1].split("\n")[0] and "Page" not in none
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_lines_recur_from_two_texts(spark):
    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    eight, seven = "a line of eight words in two texts", "a line of seven words in two"
    rows = [(i, f"{['one', 'two', 'three'][i]} of its own\n{passage}" + (f"\n{eight}\n{seven}" if i else ""), None, None, None) for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {0: rows[0][1], 1: f"two of its own\n{eight}\n{seven}", 2: f"three of its own\n{seven}"}
    five = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), long_docs=line_dedup.MIN_DOCS)
    assert {r["lines_dropped"] for r in five.collect()} == {0}


def test_similar_lines_share_a_template(spark):
    names = ["red", "blue", "green", "pink", "grey", "black"]
    rows = [(i, f"dear reader we wish you a very {n} day from all of us", None, None, None) for i, n in enumerate(names)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["lines_dropped"] for r in got} == {0: 0} | {i: 1 for i in range(1, 6)}


def plain_templates(lines, similar=0.7):
    """line -> template within one leaf, one template at a time."""
    order, heads, out = sorted(lines, key=lambda x: (-lines[x], x)), [], {}
    for x in order:
        out[x] = next((h for h in heads if sum(a == b for a, b in zip(h.split(" "), x.split(" "))) / len(x.split(" ")) >= similar), None)
        if out[x] is None:
            heads.append(x)
            out[x] = x
    return out


def plain_templates_of_many(lines, similar=0.7):
    """plain_templates with each line compared with all templates before it at once."""
    order = sorted(lines, key=lambda x: (-lines[x], x))
    names = {w: i for i, w in enumerate(sorted({w for x in order for w in x.split(" ")}))}
    codes = np.array([[names[w] for w in x.split(" ")] for x in order], np.int32)
    heads, at, out = np.zeros_like(codes), [], {}
    for i, x in enumerate(order):
        like = np.flatnonzero((heads[: len(at)] == codes[i]).sum(axis=1) / codes.shape[1] >= similar)
        if len(like):
            out[x] = order[at[like[0]]]
        else:
            heads[len(at)] = codes[i]
            at.append(i)
            out[x] = x
    return out


@pytest.mark.parametrize("tokens, n", [(5, 400), (8, 2000), (10, 20_000), (17, 1500), (30, 1500)])
def test_a_leaf_of_many_lines(spark, tokens, n):
    """Lines of one leaf: families whose variants overlap, chains from one to the next, and lines like no other."""
    rng = random.Random(tokens)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmno"]
    lines, most = set(), int(tokens * 0.3 + 1e-9)
    while len(lines) < n:
        base = [rng.choice(words) for _ in range(tokens - 3)]
        for _ in range(rng.choice([1, 1, 1, 1, 4, 12, 40])):
            lines.add(" ".join(["in", "this", "leaf", *base]))
            for _ in range(rng.randint(1, most)):
                base[rng.randrange(len(base))] = rng.choice(words)  # drifts away from the first of its family
    rows = [(i, x, None, None, None) for i, x in enumerate(sorted(lines, key=lambda _: rng.random()))]
    many = Counter({x: 1 for x in lines})
    templates = plain_templates_of_many(many)
    if n <= 2000:
        assert templates == plain_templates(many)
    first, docs = {}, Counter(templates[x] for _, x, *_ in rows)
    for _, x, *_ in rows:
        first.setdefault(templates[x], x)
    least = 2 if tokens >= 8 else 5
    want = {i: int(docs[templates[x]] >= least and first[templates[x]] != x) for i, x, *_ in rows}
    began = time.monotonic()
    got = {r["doc_id"]: r["lines_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    took = time.monotonic() - began
    assert got == want
    assert took < 240


def test_a_leaf_has_as_many_templates_as_families(spark):
    rng = random.Random(4)
    tail = ["sunny skies over hill and lake today", "heavy rain near coast and port tonight", "quiet roads about town and field again", "late trains from north and east now"]
    rows = []
    for i in range(32):
        words = ("in this report " + tail[i % 4]).split(" ")
        words[rng.choice([3, 5, 9])] = rng.choice("abcdefghijklmnop")
        rows.append((i, " ".join(words), None, None, None))
    many = Counter(r[1] for r in rows)
    templates = plain_templates(many)
    first = {}
    for i, text, *_ in rows:
        first.setdefault(templates[text], text)
    docs = Counter(templates[x] for x in many)
    assert sum(n >= 2 for n in docs.values()) >= 4
    want = {i: int(docs[templates[t]] >= 2 and first[templates[t]] != t) for i, t, *_ in rows}
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r["doc_id"]: r["lines_dropped"] for r in got} == want


def shares(x):
    return x / x.sum()


def test_raked_weights_meet_the_margins(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(5, 300)), rng.choice(["en", "en", "en", "de"]), rng.choice(["s0"] * 6 + ["s1", "s2"]), 1) for i in range(800)]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    df = mixed.toPandas()
    assert df["probability"].between(0, 1).all() and df["probability"].max() == 1
    report = mixing.margins(mixed).toPandas().set_index(["margin", "value"])
    for margin, column in (("source", "_source"), ("lang", "_lang"), ("topic", "_topic")):
        goal = shares(df.groupby(column)["_tokens"].sum() ** mixing.TEMPER[margin])
        assert (abs(report.loc[margin]["target"].reindex(goal.index) - goal) < 1e-9).all()
        for name in ("probability", "weight"):
            got = shares((df["_tokens"] * df[name]).groupby(df[column]).sum())
            assert (abs(got - goal) < 2e-3).all(), margin
            assert (abs(report.loc[margin]["by_" + name].reindex(got.index) - got) < 1e-9).all()
    assert abs((df["_tokens"] * df["weight"]).sum() / df["_tokens"].sum() - mixing.VOLUME) < 1e-6
    goal = shares(df.groupby("_source")["_tokens"].sum() ** mixing.TEMPER["source"])
    for drawn in (df["kept"], df["copies"]):
        assert (abs(shares((df["_tokens"] * drawn).groupby(df["_source"]).sum()) - goal) < 0.08).all()


def test_rare_sources_reach_their_targets(spark):
    sources = ["big"] * 1000 + [f"mid{k % 18}" for k in range(1988)] + [f"rare{k % 4}" for k in range(12)]
    df = mixing.mix(spark.createDataFrame([(i, "w " * 20, "en", s, 1) for i, s in enumerate(sources)], SCHEMA), volume=1.0).toPandas()
    goal = shares(df.groupby("_source")["_tokens"].sum() ** mixing.TEMPER["source"])
    for name in ("probability", "weight"):
        assert (abs(shares((df["_tokens"] * df[name]).groupby(df["_source"]).sum()) / goal - 1) < 1e-6).all()
    assert (abs(df["copies"] - df["weight"]) < 1).all() and (df["copies"][df["weight"] > 1] >= 1).all() and df["weight"].max() > 2


def test_given_targets(spark):
    rows = [(i, "w " * 50, "en", f"s{i % 4}", 1) for i in range(400)]
    goal = spark.createDataFrame([("s0", 6.0), ("s1", 3.0), ("s2", 1.0), ("absent", 10.0)], "value string, share double")
    df = mixing.mix(spark.createDataFrame(rows, SCHEMA), goals={"source": goal}).toPandas()
    got = shares((df["_tokens"] * df["probability"]).groupby(df["_source"]).sum())
    assert (abs(got - got.index.map({"s0": 0.6, "s1": 0.3, "s2": 0.1, "s3": 0.0})) < 1e-9).all()
    assert not df["kept"][df["_source"] == "s3"].any() and not df["copies"][df["_source"] == "s3"].any()


def test_mixing_awkward_rows(spark):
    out = mixing.mix(frame(spark).repartition(3))
    assert out.count() == len(documents())
    rows = out.select("doc_id", "_source", "_lang", "_topic", "_tokens").collect()
    assert {r["_topic"] for r in rows if r["_tokens"] == 0} == {"(none)"}
    assert "(none)" in {r["_source"] for r in rows}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, "", None, None, 0), (2, None, None, None, None)], SCHEMA)
    assert [r["probability"] for r in mixing.mix(blank).collect()] == [1.0, 1.0]


def plain_verdict(text, rules):
    """The base rules, then the list in order, from plain counts of the text."""
    n, chars, symbols, dup, repeat = stats(text)
    if n < 50 or 100 * repeat > 50 * n:
        return False
    t = text or ""
    letters = sum(c.isascii() and c.isalpha() or 0xC3 <= c.encode()[0] < 0xF5 for c in t)
    counts = {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_chars_all": len(t), "n_letters": letters,
        "n_upper": sum("A" <= c <= "Z" for c in t), "n_digits": sum(c in "0123456789" for c in t), "n_bangs": sum(c in "!?" for c in t), "n_bars": t.count("|"), "n_lines": t.count("\n") + 1,
    }
    value = {name: counts[a] / counts[b] if counts[b] else 0.0 for name, a, b in quality_rules.RATIOS} | {"n_words": float(n)}
    for rule in rules:
        if all((value[c.feature] >= c.cut) == c.above for c in rule.conditions):
            return rule.verdict
    return True


def test_pipeline_stages(spark, library):
    """Each stage against a plain version of what it must keep, on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "packed"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.saved(stage(spark, tables[-1], sf), f"test-{name}")
        if name != "packed":
            assert out.columns == docs.columns
        tables.append(out)
    quality, lines, single, mixed, packed = (t.collect() for t in tables[1:])
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.fit(docs, labels)
    assert Counter(r["doc_id"] for r in quality) == Counter(r["doc_id"] for r in docs.collect() if plain_verdict(r["text"], rules))

    def by_sql(text, rows):
        """The operator's SQL on what the stage was given."""
        import duckdb
        import pandas as pd

        c = duckdb.connect()
        c.register("documents", pd.DataFrame([r.asDict() for r in rows]))
        return c.sql(text).fetchall()

    by_line = line_dedup.sql(sharding.crc_sql("text"), sharding.CRC_TABLE_SQL)
    crc = by_sql(by_line, quality)
    left = {r[0]: r[2] for r in by_sql(by_line.replace("strlen(text)::BIGINT AS n_bytes", "text AS n_bytes"), quality)}
    texts = {r["doc_id"]: r["text"] for r in lines}
    for doc, dropped, size, code in crc:
        if doc in texts:
            assert (len(texts[doc].encode()), zlib.crc32(texts[doc].encode())) == (size, code)
        else:
            assert dropped and not re.search(r"[^ \t\n\x0b\f\r]", left[doc])  # no word is left
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    from cases import groups

    roots = {c for (_, _, c) in groups([(r["doc_id"], r["text"]) for r in lines])}
    assert {r["doc_id"] for r in single} == roots
    copies = {doc: n for doc, *_, n in by_sql(mixing.sql(), single) if n}
    assert Counter(r["doc_id"] for r in mixed) == Counter(copies)
    check_packing([(r["doc_id"], r["text"]) for r in mixed], packed, library, 1024)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert len(whole) == len(packed)


def test_pipeline_on_awkward_and_empty_documents(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (documents(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert docs.count() >= (1 if rows else 0)
