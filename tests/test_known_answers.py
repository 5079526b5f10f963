"""Published or hand-made answers for kernels and rules."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import color as C
from gleaner.functions import spec as P
from gleaner.functions import text as T
from gleaner.functions.hashing import sha256_mod, split_of
from gleaner.operators import lut as L
from gleaner.operators import measure as M
from gleaner.operators import similarity as SI
from gleaner.operators import stats as S
from gleaner.operators.components import components
from gleaner.operators.parsing import format_codes, parse_output, project_codes, valid_sequence
from gleaner.operators.selection import farthest_points, numbered, quota_select
from gleaner.operators.sharding import reconcile, shard_files
from gleaner.operators.similarity import cells_that_meet, cosine_pairs, hamming_pairs, jaccard_pairs, pivot_cells, unit_vectors
from gleaner.operators.validation import require_valid
from gleaner.registry import QUERIES


def one(df):
    return df.first()


def test_ciede2000_published_pairs(spark):
    pairs = [
        ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, 2.49, -0.001), (50, -2.49, 0.0011), 7.2195), ((50, 2.5, 0), (73, 25, -18), 27.1492),
        ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((22.7233, 20.0904, -46.694), (23.0331, 14.973, -42.5619), 2.0373), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
    ]
    df = spark.createDataFrame([(*map(float, a), *map(float, b), d) for a, b, d in pairs], "l double, a double, b double, l2 double, a2 double, b2 double, d double")
    for r in C.with_ciede2000(df, ("l", "a", "b"), ("l2", "a2", "b2")).collect():
        assert abs(r["de"] - r["d"]) < 1e-4
    for a, b, d in pairs:
        assert abs(C.numpy_ciede2000(a, b) - d) < 1e-4


def test_lab_of_white_and_black(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 0.0, 0.0)], "r double, g double, b double")
    white, black = C.with_lab(df, ("r", "g", "b"), ("l", "a", "bb")).collect()
    assert abs(white["l"] - 100) < 1e-3 and abs(white["a"]) < 0.01 and abs(white["bb"]) < 0.01
    assert abs(black["l"]) < 1e-9


def test_wilson_and_mcnemar(spark):
    df = spark.createDataFrame([(8, 10, 3, 9), (0, 0, 0, 0)], "k long, n long, b long, c long")
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    p, stat = S.mcnemar(F.col("b"), F.col("c"))
    full, none = df.select(lo.alias("lo"), hi.alias("hi"), p.alias("p"), stat.alias("stat")).collect()
    assert abs(full["lo"] - 0.4901625) < 1e-6 and abs(full["hi"] - 0.9433178) < 1e-6
    exact = min(1.0, 2 * sum(math.comb(12, i) for i in range(4)) / 2**12)
    assert abs(full["p"] - exact) < 1e-9 and abs(full["stat"] - 25 / 12) < 1e-9
    assert none["lo"] is None and none["p"] == 1.0 and none["stat"] == 0.0


def test_t_quantiles():
    for df, t in ((1, 12.7062), (4, 2.7764), (9, 2.2622), (30, 2.0423), (10**7, 1.95996)):
        assert abs(S.t_quantile(0.975, df) - t) < 1e-3


def test_split_hash_matches_big_integers(spark):
    import hashlib

    names = [f"unit_{i}" for i in range(50)]
    got = {r["u"]: (r["m"], r["s"]) for r in spark.createDataFrame([(n,) for n in names], "u string").select("u", sha256_mod(F.col("u")).alias("m"), split_of(F.col("u")).alias("s")).collect()}
    for n in names:
        assert got[n][0] == int(hashlib.sha256(n.encode()).hexdigest(), 16) % 10_000_000
        x = int(hashlib.sha256(f"{n}:1234".encode()).hexdigest(), 16) % 10_000_000 / 10_000_000
        assert got[n][1] == ("train" if x < 0.8 else "eval" if x < 0.9 else "diagnostic" if x < 0.97 else "qualitative")


def test_parser_and_grammar(spark):
    good = "<lut_bos> " + " ".join(f"<lut_{i:03d}>" for i in range(64)) + " <lut_eos>"
    cases = {good: "lut_tokens", "<unsupported>": "unsupported", " <unsupported>\n": "unsupported", "": "invalid", None: "invalid", "hello": "invalid", good + " x": "invalid", good.replace("<lut_063>", "<lut_256>"): "invalid", good.replace(" <lut_063>", ""): "invalid"}
    rows = spark.createDataFrame([(t, k) for t, k in cases.items()], "t string, k string").select("t", "k", parse_output(F.col("t")).alias("p"), valid_sequence(F.col("t")).alias("v")).collect()
    for r in rows:
        assert r["p"]["kind"] == r["k"], r
        if r["t"] is not None:
            assert r["v"] == (r["k"] != "invalid"), r
    assert one(spark.range(1).select(format_codes(F.lit(list(range(64)))).alias("t")))["t"] == good


def test_spec_round_trip_and_malformed(spark):
    text = "route=grade | warmer=+2.4 muted=+1.0 shadow_hue=210 sat_red=-1.5 | conf=0.90"
    p = P.parsed(F.col("t"))
    r = one(spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in p.items()]))
    assert r["route"] == "grade" and r["conf"] == 0.9 and r["axes"] == {"temperature_delta_b": 2.4, "chroma_delta": -1.0, "shadow_hue_deg": 210.0, "sat_red": -1.5}
    assert one(spark.createDataFrame([("nonsense",)], "t string").select(p["route"].alias("r"), p["axes"].alias("a")))["a"] is None
    twice = "route=grade | warmer=+2.0 brighter=+1.0 cooler=+3.0 brighter=+1.5 brighter=x"
    assert one(spark.createDataFrame([(twice,)], "t string").select(p["axes"].alias("a")))["a"] == {"temperature_delta_b": -3.0, "mean_l_delta": 1.5}


def awkward_specs():
    rng = random.Random(3)
    values = ["+2.4", "-0.5", "1", "2.45", "2.35", "-0.04", "", "x", "1e3", "1d", "0x1p3", " 7", "NaN", "nan", "+NaN", "Infinity", "-inf", "1_0", "1.", ".5", "3=4", "5.95", "1e300", "999999999999999.12", "+", "0"]
    made = [" ".join(f"{rng.choice([*P.TAGS, 'odd'])}={rng.choice(values)}" for _ in range(rng.randrange(9))) for _ in range(400)]
    edges = [None, "", "route=", "x", "route=grade", " route=grade | warmer=+1.0\nroute=grade | cooler=1", "route=grade|warmer=1|conf=0.9|\tmuted=2\x0bsat_red=-1\rmatte=3", "route=refuse | refuse=out_of_scope", "route=grade |  | warmer", "route=grade | conf=1 warmer=2 |  darker=2.25 | a | b | c | d | e | f | g | brighter=9"]
    return edges + ["route=grade | " + m for m in made]


def test_arrow_specs_equal_column_forms(spark):
    texts = awkward_specs()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(texts * 3, texts[1:] + texts[:1] + texts[7:] + texts[:7] + texts))], "i long, p string, g string")
    df = df.withColumn("x", P.parsed(F.col("p"))["axes"]).withColumn("y", P.parsed(F.col("g"))["axes"])
    p, g = P.directions(F.col("x")), P.directions(F.col("y"))
    plain = [P.f1(P.share(p, g, how), P.share(g, p, how)) for how in ("sign", "bucket", "value")]
    rows = df.select("i", "x", P.axes(F.col("p")).alias("got_x"), F.struct(*plain, P.share(F.col("x"), F.col("y"), "value")).alias("want"), P.compared(F.col("p"), F.col("g")).alias("s"), P.borne_out(F.col("p"), F.col("g")).alias("b")).collect()
    assert len(rows) == 3 * len(texts)
    for r in rows:
        assert (None if r["x"] is None else sorted((k, repr(v)) for k, v in r["x"].items())) == (None if r["got_x"] is None else sorted((k, repr(v)) for k, v in r["got_x"].items())), r
        assert repr(tuple(r["want"])) == repr((*(r["s"] or (None,) * 3), r["b"])), r


def test_spec_queries_read_texts_without_lambdas(spark):
    for name in ("spec_compare_f1", "backing_check"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" not in plan and "ArrowEvalPython" in plan


def test_signed_rounds_once_and_as_before(spark):
    values = [0.0, -0.0, -0.04, -0.05, -0.05000000000000001, 0.05, 0.25, 0.35, -0.45, 0.5, -0.5, 8999999.95, 9e6, 9999999.94, 9999999.96, -1e7, 1e20, float("nan"), float("inf"), float("-inf"), None, *[i / 40 for i in range(-200, 200)]]
    v, tenth = F.col("v"), F.bround("v", 1)
    plain = F.concat(F.when(tenth < 0, "-").otherwise("+"), F.format_string("%.1f", F.abs(tenth)))
    up, down = (F.when((F.abs(v) >= 0.5) & sign, "written") for sign in (tenth >= 0, tenth < 0))
    parts = P._parts({"mean_l_delta": v}, False)
    rows = spark.createDataFrame([(x,) for x in values], "v double").select("v", plain.alias("a"), P.signed(v).alias("b"), up.alias("u"), down.alias("d"), parts["brighter"].alias("gu"), parts["darker"].alias("gd")).collect()
    for r in rows:
        assert r["v"] is None or r["a"] == r["b"], r
        assert ((r["u"] is None), (r["d"] is None)) == ((r["gu"] is None), (r["gd"] is None)), r
    assert spark.range(1).select(P.signed(F.col("id").cast("double")).alias("s"))._jdf.queryExecution().optimizedPlan().toString().count("bround") == 2


def test_shuffled_tokens(spark):
    texts = [t for t in awkward_specs() if t is not None and " | " in t] + ["a | b=1 c=2 | d | e", "none", "a | no equals | b=1", "a | | b=1 | c=2", "ä | ü=1 ö=2  é=3 | ß"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", "t", P.shuffled(F.col("t"), F.col("i"), 5).alias("s")).collect()
    for r in rows:
        parts = r["t"].split(" | ")
        if len(parts) > 1 and "=" in parts[1]:
            parts[1] = " ".join(sorted(parts[1].split(" "), key=lambda x: (hashlib.md5(f"5:{r['i']}:{x}".encode()).hexdigest(), x)))
        assert r["s"] == " | ".join(parts), r


def test_tags_and_cues(spark):
    df = spark.createDataFrame([(["Desaturated", "warmer", "muted", "odd"], "Please remove the car", "content_removal"), ([], "swarmed by lukewarm tea ok", "underspecified_intent"), ([], "make it warmer please", "underspecified_intent")], "tags array<string>, t string, c string")
    rows = df.select(T.normal_tags(F.col("tags")).alias("tags"), T.prompt_issue(F.col("t"), F.col("c")).alias("issue"), T.route(F.col("c")).alias("route")).collect()
    assert rows[0]["tags"] == ["muted", "warmer"] and rows[0]["issue"] is None and rows[0]["route"] == "refuse"
    assert rows[1]["issue"] is None and rows[1]["route"] == "clarify"
    assert rows[2]["issue"] == "names_supported_direction:warm"


def test_components_on_paths_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 17) for i in range(17)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    parent = {i: i for i in range(400)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    for parts in (1, 7):
        links = spark.createDataFrame(edges, "a long, b long").repartition(parts)
        got = {r["id"]: r["root"] for r in components(spark.range(400), links).collect()}
        assert got == {i: root(i) for i in range(400)}


def test_similarity_joins_match_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(25)]
    texts = base + [t + " extra" for t in base[:12]] + base[:5] + ["", None, "one", "one two"]
    rows = [(i, t) for i, t in enumerate(texts)]

    def grams(t):
        w = (t or "").lower().split()
        return set(w) if len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    want = {(i, j) for i, a in rows for j, b in rows if i < j and grams(a) and grams(b) and len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))}
    got = {(r["a"], r["b"]) for r in jaccard_pairs(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == want
    bits = [rng.getrandbits(64) for _ in range(30)]
    bits += [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in bits] + bits[:3]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    want = {(i, j, bin(a ^ b).count("1")) for i, a in enumerate(bits) for j, b in enumerate(bits) if i < j and bin(a ^ b).count("1") <= 6}
    assert {tuple(r) for r in hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, h long")).collect()} == want
    vs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)] + [[0.0] * 6]
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    want = {(i, j) for i, a in enumerate(vs) for j, b in enumerate(vs) if i < j and sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b) >= 0.6}
    assert {(r["a"], r["b"]) for r in cosine_pairs(spark.createDataFrame(list(enumerate(vs)), "id long, v array<double>"), 0.6, block=16).collect()} == want


def test_cosine_pairs_of_clusters(spark):
    """All pairs are found, each once, although most cells never meet; empty tables and null vectors give nothing."""
    rng = random.Random(12)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vs = [[3 * x + rng.gauss(0, 0.05) for x in centres[i % 12]] for i in range(300)] + [[0.0] * 8] * 2 + [centres[0]] * 3
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    want = sorted((i, j) for i, a in enumerate(vs) for j, b in enumerate(vs) if i < j and sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b) >= 0.97)
    df = spark.createDataFrame([*enumerate(vs), (999, None)], "id long, v array<double>")
    assert sorted((r["a"], r["b"]) for r in cosine_pairs(df.repartition(5), 0.97, block=10).collect()) == want
    cells, span = pivot_cells(unit_vectors(df).where("v IS NOT NULL"), np.array([[x / norm(c) for x in c] for c in centres]))
    meet = cells_that_meet(span, math.sqrt(2 - 2 * 0.97))
    assert cells.count() == len(vs) and len(meet) < 12 * 13 / 2 / 2
    assert cosine_pairs(df.limit(0), 0.5).count() == 0


def test_quota_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice(["x", "y", "z"]), i) for i in range(200)]
    caps, target, buckets = {"a": 0.2, "b": 0.05}, 90, ["x", "y"]
    size, used, want = min(target, len(rows)), {}, []
    for k in range(len(buckets)):
        for i, fam, bucket, _ in rows:
            at = buckets.index(bucket) if bucket in buckets else len(buckets) - 1
            if at == k and len(want) < size and (fam not in caps or used.get(fam, 0) < int(caps[fam] * size)):
                used[fam] = used.get(fam, 0) + 1
                want.append(i)
    df = spark.createDataFrame(rows, "id long, family string, bucket string, ord long").repartition(5)
    got = quota_select(df, spark.createDataFrame(list(caps.items()), "family string, share double"), target, buckets).orderBy("rank").collect()
    assert [r["id"] for r in got] == want


def test_farthest_points_numbering_and_shards(spark):
    vs = [(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [0.0, 9.0]), (3, [1.0, 1.0])]
    got = farthest_points(spark.createDataFrame(vs, "id long, v array<double>"), 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 0]
    for parts in (1, 6):
        rows = numbered(spark.range(100).repartition(parts), ["id"]).collect()
        assert {r["id"]: r["n"] for r in rows} == {i: i for i in range(100)}
    files = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 500), (1, 4, 10), (1, 5, 90)], "pack long, name long, bytes long")
    assert [r["shard"] for r in shard_files(files, 100).orderBy("name").collect()] == [0, 1, 2, 3, 3]
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, h string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (4, "z")], "k long, h string")
    assert {r["k"]: r["state"] for r in reconcile(a, b, "k", "h").collect()} == {1: "same", 2: "changed", 3: "only_left", 4: "only_right"}


def test_cube_text(spark):
    grid = L.grid(spark, 3).select(F.lit("t").alias("lut"), F.lit(3).alias("n"), "r", "g", "b", *[(F.col(p) / 2).alias(c) for c, p in zip("xyz", "rgb")])
    text = L.serialize_cube(grid, "lut")
    back = L.parse_cube(text.select(F.col("lut").alias("name"), "content")).collect()
    assert len(back) == 27 and all((r["x"], r["y"], r["z"]) == (r["r"] / 2, r["g"] / 2, r["b"] / 2) for r in back)
    content = one(text)["content"]
    cases = {content: ("cube", None), "```\n" + content + "```": ("cube", None), "": ("invalid", "empty_output"), "<unsupported>": ("unsupported", None), content.replace("1.0000000000", "1.5000000000"): ("invalid", "out_of_range"), content[: len(content) // 2]: ("invalid", "truncated"), "no table": ("invalid", "missing_size"), content + "<unsupported>": ("invalid", "mixed_unsupported")}
    for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", L.classify_cube(F.col("t")).alias("k")).collect():
        assert (r["k"]["kind"], r["k"]["error"]) == cases[r["t"]], r["t"][:30]


def test_identity_table_changes_nothing(spark):
    rng = random.Random(4)
    pixels = spark.createDataFrame([(i, rng.random(), rng.random(), rng.random()) for i in range(50)] + [(50, -1.0, 2.0, 1.0)], "i long, u double, v double, w double")
    nodes = L.grid(spark, 17).select("r", "g", "b", *[(F.col(p) / 16).alias(c) for c, p in zip("xyz", "rgb")])
    for r in L.apply_trilinear(pixels, nodes, 17, ["i"]).join(pixels, "i").collect():
        for c, d in zip("xyz", "uvw"):
            assert abs(r[c] - min(1.0, max(0.0, r[d]))) < 1e-9


def test_invalid_rows_fail_the_job(spark):
    df = spark.createDataFrame([(1, ["missing_file_hash"], "rejected"), (2, [], "gold")], "id long, errors array<string>, tier string")
    assert require_valid(df, "errors", F.col("tier") == "rejected").count() == 2
    with pytest.raises(Exception, match="invalid row"):
        require_valid(df.replace("rejected", "gold"), "errors", F.col("tier") == "rejected").collect()


def test_behaviour_of_simple_tables(spark):
    import numpy as np

    from gleaner.operators import measure as M

    plain = M.measured(M._cube(np.linspace(0, 1, 17)).reshape(17, 17, 17, 3))
    for field in ("temperature_delta_b", "mean_l_delta", "chroma_delta", "smoothness", "foldover_rate", "residual_norm", "skin_locus_deltaE00_mean", "contrast_toe_delta", "matte_strength"):
        assert abs(plain[field]) < 1e-6, field
    made = M.procedural(spark, 9).toPandas()
    vectors = {name: M.measured(M._dense(part, 9)) for name, part in made.groupby("name")}
    for tag, field, sign in (("warmer", "temperature_delta_b", 1), ("cooler", "temperature_delta_b", -1), ("brighter", "mean_l_delta", 1), ("muted", "chroma_delta", -1), ("lifted_blacks", "black_point_l_delta", 1), ("tint_magenta", "tint_delta_a", 1)):
        values = [sign * vectors[f"{tag}_m{i}"][field] for i in range(3)]
        assert values[0] > 0.5 and values == sorted(values), tag
    pairs = np.array([[50, 2.6772, -79.7751], [50, 2.5, 0.0]]), np.array([[50, 0, -82.7485], [73.0, 25, -18]])
    assert np.allclose(M.ciede2000(*pairs), [2.0425, 27.1492], atol=1e-4)


def test_fill_keeps_observed_nodes_and_completes_the_rest(spark):
    from gleaner.operators import measure as M

    fitted = spark.createDataFrame([("a", 1, 1, 1, 10**9, 0.7, 0.5, 0.5)], "lut string, r int, g int, b int, k long, x double, y double, z double")
    rows = {(r["r"], r["g"], r["b"]): r for r in M.smooth_fill(fitted, 3, "lut").collect()}
    assert len(rows) == 27 and abs(rows[1, 1, 1]["x"] - 0.7) < 1e-6 and 0.15 < rows[0, 0, 0]["x"] < 0.21


def png(pixels):
    import struct
    import zlib

    import numpy as np

    height, width, _ = pixels.shape
    raw = b"".join(b"\x02" + ((pixels[y].astype(int) - (pixels[y - 1].astype(int) if y else 0)) & 255).astype(np.uint8).tobytes() for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark):
    import numpy as np

    from gleaner.operators import measure as M

    rng = np.random.default_rng(3)
    wave = 127 + 100 * np.sin(np.arange(64)[:, None] / 9) * np.cos(np.arange(64)[None, :] / 13)
    image = np.repeat(wave[:, :, None], 3, axis=2).astype(np.uint8)
    near = np.clip(image + rng.integers(-1, 2, image.shape), 0, 255).astype(np.uint8)
    assert (M.read_png(png(image)) == image).all()
    far = rng.integers(0, 255, (64, 64, 3)).astype(np.uint8)
    files = spark.createDataFrame([("a", bytearray(png(image))), ("b", bytearray(png(near))), ("c", bytearray(png(far))), ("d", bytearray(b"junk"))], "path string, content binary")
    h = {r["path"]: r["phash"] for r in M.image_hashes(files).collect()}
    gap = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    assert gap(h["a"], h["b"]) <= 6 < gap(h["a"], h["c"]) and h["d"] is None
    level = 2
    i = np.arange(level**6)
    edge = level * level
    hald = np.stack([i % edge, i // edge % edge, i // edge**2], axis=1).reshape(level**3, level**3, 3) * 85
    assert np.allclose(M.hald_table(hald), M._cube(np.linspace(0, 1, 4)).reshape(4, 4, 4, 3))


def test_config_merge():
    from gleaner.functions.config import merged

    base = {"a": 1, "b": {"c": 2, "d": 3}}
    assert merged(base, {"b": {"c": 9}}) == {"a": 1, "b": {"c": 9, "d": 3}}
    with pytest.raises(KeyError, match="b.x"):
        merged(base, {"b": {"x": 1}})


def plain_bootstrap(units, replicates, seed):
    """units (key, num, den) -> percentiles of the ratio of sums under Poisson counts."""
    ratios = []
    for r in range(replicates):
        top = bottom = 0
        for key, num, den in units:
            u = int(hashlib.md5(f"{seed}:{r}:{key}".encode()).hexdigest()[:8], 16) / 2**32
            w, total, term = 0, math.exp(-1), math.exp(-1)
            while w < 8 and u >= total:
                w += 1
                term /= w
                total += term
            top, bottom = top + w * num, bottom + w * den
        if bottom:
            ratios.append(top / bottom)
    return np.percentile(ratios, [2.5, 97.5])


def test_whole_bootstraps_by_brute_force(spark, tmp_path):
    docs = [(i, "en" if i < 7 else "de", "s") for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    lines = [(k % 5, "R" if (k * 7) % 11 < 4 else "N") for k in range(60)]
    spark.createDataFrame(lines, "l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["lang"]: (r["low"], r["high"]) for r in QUERIES["paired_bootstrap_whole"](spark, str(tmp_path)).collect()}
    for lang in ("en", "de"):
        u = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:4], 16) % 100 for i, x, _ in docs if x == lang}
        assert got[lang] == pytest.approx(plain_bootstrap([(i, (v < 80) - (v % 10 < 7), 1) for i, v in u.items()], 10_000, 5), abs=2e-6)
    units = [(k, sum(f == "R" for s, f in lines if s == k), sum(s == k for s, _ in lines)) for k in range(5)]
    r = QUERIES["cluster_bootstrap_whole"](spark, str(tmp_path)).first()
    assert (r["low"], r["high"]) == pytest.approx(plain_bootstrap(units, 2_000, 9), abs=2e-6)


def test_poisson_counts_of_digests_are_those_of_their_numbers(spark):
    """The bounds as text against the quantiles of the number, at every bound and beside it."""
    bounds, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        bounds.append(total)
        term /= k + 1
    edge = [math.ceil(b * 2**32) + d for b in bounds for d in (-1, 0, 1)] + [0, 2**32 - 1]
    rows = spark.createDataFrame([(n, f"{n:08x}" + t * 24) for n in edge for t in "0f"], "n long, h string")
    for n, w in rows.select("n", S.poisson_weight(F.col("h"))).collect():
        assert w == next((k for k, b in enumerate(bounds) if n / 2**32 < b), 8)


def test_shards_of_many_packs_in_one_pass(spark):
    """Packs of a task in one walk, over batches smaller than a pack; files of one name by size, null sizes as 0."""
    files = [(p, n, 30 + (p * n) % 70) for p in range(5) for n in range(40)] + [(9, 1, 80), (9, 1, 10), (9, 2, None), (9, 3, 20), (None, 1, 5)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {tuple(r)[:3]: r["shard"] for r in shard_files(spark.createDataFrame(files, "pack long, name long, bytes long"), 100).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    for p in range(5):
        shard = held = 0
        for n in range(40):
            size = 30 + (p * n) % 70
            shard, held = (shard + 1, size) if held and held + size > 100 else (shard, held + size)
            assert got[p, n, size] == shard
    assert [got[9, 1, 10], got[9, 1, 80], got[9, 2, None], got[9, 3, 20], got[None, 1, 5]] == [0, 0, 0, 1, 0]


def test_tables_of_a_batch_are_measured_together(spark):
    """Null and text keys, batches that end inside a table."""
    rng = np.random.default_rng(5)
    tables = {k: rng.random((3, 3, 3, 3)) for k in ("a", "b", None)}
    rows = [(k, r, g, b, *map(float, t[r, g, b])) for k, t in tables.items() for r in range(3) for g in range(3) for b in range(3)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = {r["k"]: r.asDict() for r in M.behavior(spark.createDataFrame(rows, "k string, r int, g int, b int, x double, y double, z double"), 3, "k").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert {k: {f: got[k][f] for f in M.FIELDS} for k in tables} == {k: M.measured(t) for k, t in tables.items()} and len(got) == 3


def test_gram_hashes_name_the_grams_of_gram_set(spark):
    texts = ["a b c a b c d", "A b", "", None, "x " * 50, "eins zwei drei", "a b c", "a_b c\nd"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").cache()
    sizes = rows.select(F.size(SI.gram_set(F.col("text"), 3)), F.size(SI.gram_hashes(F.col("text"), 3)), "text").collect()
    assert all(a == b for a, b, text in sizes if text is not None)
    members, sets = SI.gram_classes(rows, 3)
    assert sorted(r["id"] for r in members.collect()) == [0, 1, 4, 5, 6, 7]  # neither the empty text nor the missing one
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # grams are made once and kept


def test_ranks_of_shared_grams_count_those_of_one_document(spark):
    sets = spark.createDataFrame([(1, [10, 11, 12, 13]), (2, [12, 13, 20]), (3, [13, 30])], "id long, grams array<long>")
    assert sorted((r["id"], r["gram"], r["rank"]) for r in SI._ranked(sets).collect()) == [(1, 12, 3), (1, 13, 4), (2, 12, 2), (2, 13, 3), (3, 13, 2)]


def test_projection_reads_a_text_once_and_bounds_codes(spark):
    codes = [f"<lut_{n:03d}>" for n in (0, 9, 99, 199, 200, 249, 250, 255, 256, 260, 299, 300, 999)]
    rows = spark.createDataFrame([(" ".join(["<lut_bos>", *codes, "<lut_25>", "<lut_0255>"]),)], "t string").select(project_codes(F.col("t")).alias("p"))
    got = rows.first()["p"].split(" ")
    assert got == ["<lut_bos>", *codes[:8], *["<lut_000>"] * 56, "<lut_eos>"]
    assert rows._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_second_differences_are_found_in_one_shuffle(spark):
    nan = float("nan")
    nodes = [(k, r, g, b, ((k + 2) * r * r + g * b) / 9.0, (g * g * b + r) / 7.0, None if (r, g, b) == (1, 1, 1) and k == 2 else r * g * b / 5.0) for k in (1, 2) for r in range(4) for g in range(4) for b in range(3) if (k, r, g, b) != (1, 2, 0, 0)]
    nodes += [(3, 0, 0, 0, 0.1, 0.2, 0.3), (4, 0, 0, 0, nan, 0.0, 0.0), (4, 1, 0, 0, 0.0, 0.0, 0.0), (4, 2, 0, 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(nodes, "lut int, r int, g int, b int, x double, y double, z double")
    done = L.second_difference(df, 4, ["lut"])
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    expected = {}
    for k in (1, 2, 4):
        gaps = []
        for axis in range(3):
            lines = {}
            for _, *p in (t for t in nodes if t[0] == k):
                lines.setdefault(tuple(v for i, v in enumerate(p[:3]) if i != axis), []).append((p[axis], [None if c is None else c - i / 3 for c, i in zip(p[3:], p[:3])]))
            for line in lines.values():
                line = [v for _, v in sorted(line, key=lambda t: t[0])]
                gaps += [abs(w[c] - 2 * v[c] + u[c]) for u, v, w in zip(line, line[1:], line[2:]) for c in range(3) if None not in (u[c], v[c], w[c])]
        gaps.sort(key=lambda v: (v != v, v))
        at = 0.99 * (len(gaps) - 1)
        low, high = gaps[int(at)], gaps[min(int(at) + 1, len(gaps) - 1)]
        expected[k] = (low + (at - int(at)) * (high - low)) * (3 / 16) ** 2
    got = dict(map(tuple, done.collect()))
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], nan_ok=True) for k in expected)
