import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, documents, frame, groups
from pyspark.sql import functions as F

from gleaner.llm import ngram_join, sharding, topk_search, url_filters
from gleaner.llm.keys import without_keys
from gleaner.llm.store import saved


@pytest.mark.parametrize("parts, blocks", [(1, 2), (7, 5)])
def test_ngram_join_against_all_pairs(spark, parts, blocks):
    rows = documents()
    got = ngram_join.ngram_jaccard_join(frame(spark).repartition(parts), blocks=blocks).collect()
    assert Counter(map(tuple, got)) == groups(rows)


def test_ngram_join_on_a_group_without_one_centre(spark):
    """A chain: neighbours link, ends don't; and texts of one to six words."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 100]), None, None, None) for i in range(40)]
    rows += [(100 + i, " ".join(words[: i % 7]), None, None, None) for i in range(20)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), blocks=3).collect()
    assert Counter(map(tuple, got)) == groups(rows)


def test_ngram_join_with_common_grams(spark):
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, f"{common} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 4, 6, 40]))), None, None, None) for i in range(260)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), blocks=4).collect()
    assert Counter(map(tuple, got)) == groups(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_join.ngram_jaccard_join(none).count() == 0
    assert sharding.shard(none, [1.0] * 3, [1.0] * 4).count() == 0
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string"), url_filters.rules_table(spark)).count() == 0
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_without_keys(spark):
    rows = frame(spark)
    gone = saved(spark.createDataFrame([(1,), (5,), (999,)], "doc_id long"), "gone")
    left = without_keys(rows, gone, "doc_id")
    assert left.columns == rows.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r[0]) for r in documents() if r[0] not in (1, 5))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "a.example.org/"), ("allow", "a.example.org/es/x"), ("block", "net/a"), ("allow", "net/a"), ("block", "x.net/a")]


def judged(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), len(r.split("/")[0]), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = min(fits, key=lambda f: (-f[0], -f[1], f[2])) if fits else None
    return host, path, best and best[2], best[3] if best else default


def test_url_filters_against_every_rule(spark):
    rng = random.Random(4)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "notexample.org", "example.org.", "EXAMPLE.org", "com", "x.com", "x.net", "y.x.net", "net", "", "example.org:80", "a-example.org", "ex!ample.org"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/en/12?x=/es/', '/es/x/y#z', '/a/b', '/fr/', '/de/q', '?u=http://net/a', '#/es/'])}" for _ in range(400)]
    urls += [None, "", "example.org/es/", "://", "a://b://c/d", "http://net/a\nb/c", "http://org/é"] + ["http://example.org/es/same"] * 200
    rules = [r for r in RULES if r != ("allow", "net/a")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).repartition(5)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(df, url_filters.rules_table(spark, rules)).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    nothing = url_filters.filter_urls(df, url_filters.rules_table(spark, rules).limit(0), default="block")
    assert {r["verdict"] for r in nothing.collect()} == {"block"}


def test_sharding_laws(spark):
    rows = documents()
    got = sharding.shard(frame(spark).repartition(6), [1.0] * 8, [1.0] * 9).collect()
    assert len(got) == len(rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r[0] for r in rows})


def test_sharding_follows_weights(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = Counter(r["shard"] for r in sharding.shard(df, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 1.0]).collect())
    for s, share in enumerate((1 / 6, 2 / 6, 3 / 6)):
        assert abs(got[s] / 6000 - share) < 0.03
    one = sharding.shard(df.limit(5), [1.0], [1.0, 1.0]).collect()
    assert {r["shard"] for r in one} == {0}


def brute(rows, k, every):
    """Every row against every other row of its length, in Python's own numbers."""
    vs = [(i, [int(np.floor(64.0 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, x) in enumerate(vs):
        if q % every == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), c) for m, (c, y) in enumerate(vs) if m != n and len(y) == len(x))[:k]
            out.update((q, rank, c, -s) for rank, (s, c) in enumerate(best, 1))
    return out


VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("chunk, block, span", [(4096, 512, 64 << 20), (7, 3, 500)])
def test_topk_against_brute_force(spark, monkeypatch, chunk, block, span):
    monkeypatch.setattr(topk_search, "CHUNK", chunk)
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "RANGE_BYTES", span)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)] + [(2000, None), (2001, []), (2020, [float("nan")] * 8), (2040, [None] + [0.5] * 7), (2060, [float("inf")] * 8), (None, [0.5] * 8), (2080, [0.0] * 8), rows[0], rows[0]]
    rows += [(3000 + i, [float(i), 1.0]) for i in range(25)] + [(3100, [1.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("clash")).repartition(4)
    assert Counter(tuple(r) for r in topk_search.top_k(df, k=20, every=20).collect()) == brute(rows, 20, 20)


def test_topk_counts_every_row_of_an_id(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [3.0, 3.0]), (0, [2.0, 0.0]), (1, [1.0, 0.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), k=3).collect()
    assert Counter(map(tuple, got)) == brute(rows, 3, 20)


@pytest.mark.parametrize("size", [1e7, 1e8, 3e9])
def test_topk_scores_of_large_components(spark, size):
    """Exact up to the range of a long, and ended there."""
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 1.0, -1.0])] + [(20 * i, (size * rng.normal(size=3)).tolist()) for i in range(1, 30)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    assert Counter(map(tuple, got)) == brute(rows, 5, 20)


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for top in (10**3, 10**8, 2**61):
        q, c = rng.integers(-top, top, (4, 6)), rng.integers(-top, top, (5, 6))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in c] for x in q]
        assert topk_search.products(q, c).tolist() == want


def test_topk_skips_annuli_on_clustered_vectors():
    """The bound is an upper bound, and it does rule annuli out when vectors cluster."""
    rng = np.random.default_rng(2)
    v = np.floor(64 * (rng.normal(size=(8, 16))[rng.integers(0, 8, 600)] + 0.02 * rng.normal(size=(600, 16))))
    geometry = topk_search.Geometry(list(v), float((v * v).sum(axis=1).max()))
    cell, far = geometry.place(v)
    norm, gap = geometry.asked(v[:40])
    bound = geometry.bound(norm, gap, cell, far, far)
    score = v[:40] @ v.T
    assert (bound >= score).all()
    kth = np.sort(score, axis=1)[:, -20]
    assert (bound < kth[:, None]).mean() > 0.2


def test_topk_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df).orderBy("rank").collect()] == [(1, 1, 64 * 32 + 128 * 32), (2, 2, -64 * 64)]
