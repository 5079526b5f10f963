"""Operators 11 to 13 against plain versions on awkward rows, and against SQL on the small tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from cases import documents, frame
from oracle import connect, same

from gleaner.llm import alignment, imatch, importance, queries

SF = "/root/testdata/sf0.001"
EMPTY_ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward():
    odd = ["▁under", " lead", "  two  spaces ", "tab\tnew\r\nline", "a\x00b", "<0x41> </s> <unk> <|endoftext|>", "½ ﬁ é 漢字 🙂 ​", "x", " "]
    return documents() + [(1000 + i, t, "en", "src0", len(t)) for i, t in enumerate(odd)]


def aligned_plainly(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(queries.tokenizer_path())
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.OTHER_TOKENIZER))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    docs = []
    for key, text, *_ in rows:
        whole = (" " + (text or "")).encode()
        a, b = left.encode(" " + (text or ""), add_special_tokens=False).ids, right.encode(text or "")
        of_a = [bytes(byte_of[c] for c in left.id_to_token(i)) for i in a]
        of_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            docs.append((key, [], [], []))
            continue
        ends_a, ends_b = ({sum(map(len, x[: i + 1])): i for i in range(len(x))} for x in (of_a, of_b)) if len(whole) < 3000 else (ends(of_a), ends(of_b))
        docs.append((key, a, b, [(ends_a[e], ends_b[e]) for e in sorted(ends_a.keys() & ends_b.keys())]))
    count = Counter((a[i], b[j]) for _, a, b, links in docs for i, j in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for key, a, b, links in docs:
        i = j = 0
        groups = []
        for p, q in links:
            groups.append(",".join(map(str, a[i : p + 1])) + "|" + ",".join(map(str, b[j : q + 1])))
            i, j = p + 1, q + 1
        n = [count[a[p], b[q]] for p, q in links]
        best = sum(x == most[b[q]] for x, (_, q) in zip(n, links))
        out.append((key, len(a), len(b), len(links), len(links), best, sum(n), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out


def ends(tokens):
    out, at = {}, 0
    for i, t in enumerate(tokens):
        at += len(t)
        out[at] = i
    return out


def test_alignment_equals_byte_ends(spark):
    rows = awkward()
    pair = queries.tokenizer_path(), queries.tokenizer_path(queries.OTHER_TOKENIZER)
    aligned = alignment.align(frame(spark, rows), *pair)
    counts = alignment.link_counts(aligned)
    got = alignment.digest(aligned, counts)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(aligned_plainly(rows))
    whole = got.selectExpr("sum(n_links) AS n", "sum(n_best) AS best").first()
    assert counts.selectExpr("sum(n) AS n", "sum(CASE WHEN best THEN n END) AS best").first() == whole
    nothing = alignment.align(spark.createDataFrame([], EMPTY_ROWS), *pair)
    assert alignment.digest(nothing, alignment.link_counts(nothing)).count() == 0


def test_alignment_of_long_text_is_cut_without_a_trace():
    sides = alignment.Sides(queries.tokenizer_path(), queries.tokenizer_path(queries.OTHER_TOKENIZER))
    text = " ".join(t for _, t, *_ in documents() if t and len(t) < 4000) * 3
    assert sides.cuts and len(list(sides.parts(text, alignment.BLOCK))) > 3
    cut = sides.align(text)
    sides.cuts = False
    assert all((x == y).all() for x, y in zip(cut, sides.align(text)))


def test_sides_take_turns_by_runs_of_texts(monkeypatch):
    sides = alignment.Sides(queries.tokenizer_path(), queries.tokenizer_path(queries.OTHER_TOKENIZER))
    texts = [t for _, t, *_ in documents()][:60] + [None, "", "x", " ".join(["long text"] * 9000)]
    alone = [sides.align(t) for t in texts]
    turns, plain, encode = [], sides.a.plain_ids, sides.b.EncodeAsIds
    monkeypatch.setattr(sides.a, "plain_ids", lambda t: turns.append("a") or plain(t))
    monkeypatch.setattr(sides.b, "EncodeAsIds", lambda t: turns.append("b") or encode(t))
    for run, most in ((1, None), (5000, None), (1 << 30, 2)):
        turns.clear()
        monkeypatch.setattr(alignment, "RUN", run)
        together = sides.align_all(texts)
        assert all((x is None and y is None) or all((u == v).all() for u, v in zip(x, y, strict=True)) for x, y in zip(alone, together, strict=True))
        assert most is None or sum(x != y for x, y in zip(turns, turns[1:])) < most


def test_a_word_goes_through_the_encoders_once(monkeypatch):
    sides = alignment.Sides(queries.tokenizer_path(), queries.tokenizer_path(queries.OTHER_TOKENIZER))
    read, encode = [], sides.b.EncodeAsIds
    monkeypatch.setattr(sides.b, "EncodeAsIds", lambda t: read.append(len(t)) or encode(t))
    sides.align_all([" ".join(["alpha", "beta,", "gamma."] * 9000)] * 5)
    assert sum(read) < 100 and len(sides.place) == 3


def test_words_are_aligned_as_in_their_texts(monkeypatch):
    sides = alignment.Sides(queries.tokenizer_path(), queries.tokenizer_path(queries.OTHER_TOKENIZER))
    rng = random.Random(4)
    signs = list("ab1.,'-_ é ß ½\n\t  ÀяΩ▁<>/s漢\u0301 \u200b\u3000\u00a0\x1c")
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(2000)] + [t for _, t, *_ in awkward()] + ["a ﬁ b", "a é b \u0301 c", "'s 't don't 'll", " ab cd ", "ab \u200b cd"]
    by_words = []
    for words in (250_000, 40):  # some are forgotten in between
        monkeypatch.setattr(alignment, "WORDS", words)
        sides.forget()
        by_words.append([sides.align_all(texts[k : k + 50]) for k in range(0, len(texts), 50)])
    sides.forget()
    sides.cuts = False
    whole = [sides.align_all(texts[k : k + 50]) for k in range(0, len(texts), 50)]
    for found in by_words:
        assert all((x is None and y is None) or all((u == v).all() for u, v in zip(x, y, strict=True)) for f, w in zip(found, whole) for x, y in zip(f, w, strict=True))


def test_alignment_by_bytes_equals_arrays(spark):
    pair = queries.tokenizer_path(), queries.tokenizer_path(queries.OTHER_TOKENIZER)
    kept, arrays = (f(frame(spark, awkward()), *pair) for f in (alignment.aligned_bytes, alignment.align))
    assert dict(kept.dtypes) == {"key": "bigint", "a": "binary", "b": "binary"} and arrays.columns == ["key", *alignment.ARRAYS]
    assert {t for c, t in arrays.dtypes if c != "key"} == {"array<int>"}
    got = [alignment.digest(x, alignment.link_counts(x)).collect() for x in (kept, arrays)]
    assert Counter(got[0]) == Counter(got[1]) == Counter(alignment.digest(kept, alignment.link_counts(arrays)).collect())


def test_written_groups_over_blocks(monkeypatch):
    words = [b"%d%c" % (i, end) for i in range(300) for end in b",|;"]
    rows = [[k * i % 900 for i in range(k % 7 * 3)] for k in range(40)]
    bounds = np.cumsum([0, *map(len, rows)])
    expected = [hashlib.sha256(b"".join(words[k] for k in r)[:-1]).hexdigest() if r else "" for r in rows]
    for block in (1, 5, 1 << 15):
        monkeypatch.setattr(alignment, "BLOCK", block)
        assert list(alignment._written(np.array(sum(rows, []), np.int64), bounds, pa.array(words, pa.binary()))) == expected
    assert list(alignment._written(np.zeros(0, np.int64), np.zeros(3, np.int64), pa.array([], pa.binary()))) == ["", ""]


def test_alignment_of_20_mb(spark):
    words = ["alpha", "beta,", "gamma\n", "Überraschung", "42", "delta.", "x"]
    text = " ".join(words[i * i % 7] + words[i % 5] for i in range(1_500_000))[: 20 << 20]
    pair = queries.tokenizer_path(), queries.tokenizer_path(queries.OTHER_TOKENIZER)
    aligned = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), *pair)
    row = alignment.digest(aligned, alignment.link_counts(aligned)).first()
    assert row["n_a"] > 1_000_000 and row["n_groups"] == row["n_links"] > 1_000_000


def test_transducer_rejects_other_bytes():
    t = alignment.Transducer([b"ab", b"c"], [b"a", b"bc", b"x", b"abc"])
    assert t.groups([0, 1], [0, 1]) == ([2], [2])
    assert t.groups([0, 1], [3]) == ([2], [1])
    assert t.groups([0], [2]) is None and t.groups([0], [0]) is None and t.groups([0, 1], [3, 2]) is None and t.groups([], []) == ([], [])


def features(text, longest):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))


def drawn_plainly(rows, target, longest, buckets, percent=10, least=20, seed="2024"):
    s, t, docs = Counter(), Counter(), []

    def dealt(text):
        n, f = features(text, longest)
        out = Counter()
        for g, k in f.items():
            out[zlib.crc32(g.encode()) % buckets] += k
        return n, out

    for key, text, *_ in rows:
        docs.append((key, *dealt(text)))
        s.update(docs[-1][2])
    for text in target:
        t.update(dealt(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for key, n, f in docs:
        size = sum(f.values())
        weight = sum(gain[b] * k for b, k in f.items()) // size if size else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    can = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    most = percent * len(can) // 100
    return Counter([(*r[:4], i + 1 if i < most else None) for i, r in enumerate(can)] + [(*r[:4], None) for r in out if not r[4]])


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 97)])
def test_importance_equals_plain(spark, longest, buckets):
    rows = [r for r in awkward() if r[0] is not None or r[1] and "no other" in r[1]]
    seen, once = set(), []
    for r in rows:  # of repeated rows any may have the better rank
        if r[0] not in seen:
            seen.add(r[0])
            once.append(r)
    target = [None, "", "the text of a benchmark item has words", *(t for _, t, *_ in rows[5:9])]
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, key string")
    got = importance.resample(frame(spark, once), aim, longest=longest, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == drawn_plainly(once, target, longest, buckets)


def test_importance_equals_sql(spark):
    got = queries.QUERIES["op12_importance"](spark, SF).toPandas()
    want = connect(SF).sql(queries.SQL["op12_importance"]).df()
    for f in (got, want):
        f["rank"] = pd.array(f["rank"], "Int64")
    same(got, want)


def test_importance_repeated_rows_and_empty_tables(spark):
    rows = [(7, "one two three four five " * 9, "en", "s", 1)] * 40
    got = importance.resample(frame(spark, rows), spark.createDataFrame([], "text string"))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3, 4]
    assert importance.resample(spark.createDataFrame([], EMPTY_ROWS), spark.createDataFrame([("a",)], "text string")).count() == 0


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_importance_of_cut_texts(monkeypatch, longest):
    """Pieces between words count what the whole text does, for any length of n-grams."""
    monkeypatch.setattr(importance, "PIECE", 300)
    monkeypatch.setattr(importance, "BLOCK", 2000)
    texts = [t or "" for _, t, *_ in documents()]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "row", "text"])
    total, words = Counter(), Counter()
    for out in importance._counter(longest, 97)([batch]):
        for r in out.to_pylist():
            assert r["key"] == r["row"]
            words[r["row"]] += r["n_words"]
            for b, n in zip(r["buckets"], r["times"]):
                total[r["row"], b] += n
    want = Counter()
    for i, text in enumerate(texts):
        n, f = features(text, longest)
        assert words[i] == n
        for g, k in f.items():
            want[i, zlib.crc32(g.encode()) % 97] += k
    assert total == want


def test_importance_of_20_mb(spark):
    text = "lorem Ipsum 42; dolor\n" * (20 * (1 << 20) // 22)
    row = importance.resample(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("lorem",)], "text string")).first()
    assert row["n_features"] == 4 * (20 * (1 << 20) // 22)


def fingerprints_plainly(texts, lex_texts):
    def words(t):
        return {w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w}

    def begin(parts):
        return hashlib.md5(" ".join(map(str, parts)).encode()).hexdigest()[:8]

    df = Counter(w for t in lex_texts for w in words(t))
    n = len(lex_texts)
    lex = {w for w, k in df.items() if 2 * k <= n <= 2000 * k}
    out = []
    for t in texts:
        mine = words(t)
        codes = sorted(int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in mine & lex)
        made = []
        for share, parts, bit in imatch.LEVELS:
            if share == 1:
                made.append(begin(codes) if codes else begin(sorted(mine, key=lambda w: w.encode())))
            else:
                made += [begin([c for c in codes if (c >> bit) % share == j]) for j in range(parts)]
        out.append(made)
    return out


def like_plainly(a, b):
    at, levels = 0, {}
    for share, parts, _ in imatch.LEVELS:
        x, y = levels.get(share, ([], []))
        levels[share] = (x + a[at : at + parts], y + b[at : at + parts])
        at += parts
    found = {}
    for share, (x, y) in levels.items():
        pairs = [(p, q) for p, q in zip(x, y) if {p, q} != {imatch.EMPTY}]
        found[share] = (len(pairs), sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0)
    for share in sorted(found, reverse=True):
        least = {1: 1, 4: 1}.get(share, imatch.ENOUGH)
        if found[share][0] >= least:
            return found[share][1]
    return 1.0


def test_imatch_equals_plain(spark):
    rows = sorted({r[0]: r for r in awkward() if r[0] is not None}.values())
    texts = [r[1] or "" for r in rows]
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, after)]
    a, e = fingerprints_plainly(texts, texts), fingerprints_plainly(edited, texts)
    b = a[1:] + a[:1]
    want = {r[0]: (len(t), hashlib.sha256(x.encode()).hexdigest(), "".join(p), "".join(q), like_plainly(p, q), like_plainly(p, u)) for r, t, x, p, q, u in zip(rows, texts, edited, a, e, b)}
    got = imatch.edited_fingerprints(frame(spark, rows))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    assert imatch.edited_fingerprints(spark.createDataFrame([], EMPTY_ROWS)).count() == 0


def test_imatch_equals_sql(spark):
    same(queries.QUERIES["op13_imatch"](spark, SF).toPandas(), connect(SF).sql(queries.SQL["op13_imatch"]).df())


def test_next_rows_with_a_key_of_a_third_of_all(spark):
    """Every row is the next of one row, keys ascend but once, and null keys come first."""
    keys = [5] * 400 + [None] * 20 + [i % 700 for i in range(800)]
    rows = spark.createDataFrame([(k, hash((i, k)), i) for i, k in enumerate(keys)], "key long, tie long, place long").repartition(7)
    got = [(r["place"], r["next"]["place"]) for r in imatch.with_next(rows, ["place"]).where("_extra = 0").collect()]
    assert sorted(p for p, _ in got) == sorted(q for _, q in got) == list(range(len(keys)))
    order = [(-1 if keys[p] is None else keys[p], -1 if keys[q] is None else keys[q]) for p, q in got]
    assert sum(x > y for x, y in order) == 1
    ring, at = dict(got), 0
    for _ in keys:
        at = ring[at]
    assert at == 0 and len(ring) == len(keys)
    one = spark.createDataFrame([(None, 1, 3)], "key long, tie long, place long")
    assert [r["next"]["place"] for r in imatch.with_next(one, ["place"]).where("_extra = 0").collect()] == [3]


def test_imatch_likeness_follows_shared_terms(spark):
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [" ".join(vocabulary[i * 40 : i * 40 + 200]) for i in range(90)]
    rows = [(2 * i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(2 * i + 1, t.replace(f"w{i * 40}", "changed"), "en", "s", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["near_next"] for r in imatch.edited_fingerprints(frame(spark, rows)).collect()}
    near, far = [got[2 * i] for i in range(90)], [got[2 * i + 1] for i in range(89)]
    assert sum(near) / 90 > 0.9 and 0.5 < sum(far) / 89 < 0.85


def test_imatch_of_20_mb(spark):
    text = " ".join(f"word{i % 50_000}" for i in range(2_200_000))
    rows = spark.createDataFrame([(1, text), (2, "short one"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(rows).collect()}
    assert got[1]["n_chars"] == len(text) and len(got[1]["fingerprint"]) == 8 * sum(p for _, p, _ in imatch.LEVELS)
    assert got[3]["fingerprint"] == imatch.EMPTY * (len(got[1]["fingerprint"]) // 8)
