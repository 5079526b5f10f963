"""Plugged-in operators, resamples of fixed size, and the reduced measurement's contract with the full one."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import measure as M
from gleaner.operators import resampling as B
from gleaner.operators.hooks import Gated, Hooks


@pytest.fixture
def hooks():
    h = Hooks()
    h.add("judge", "long", column=lambda t: F.length(t) > 3)
    h.add("judge", "upper", arrow=lambda b: pa.array([None if t is None else t.isupper() for t in b.column(0).to_pylist()], pa.bool_()))
    h.add("verify", "known", column=lambda t: t.isNotNull())
    h.add("acquire", "letters", column=lambda t: F.split(t, ""))
    h.add("spec", "joined", arrow=lambda b: pa.array([f"{x}-{y}" for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]))
    h.add("predict", "gated", column=lambda t: t, gate=lambda: "no weights")
    h.add("predict", "open", column=lambda t: F.upper(t), gate=lambda: None)
    return h


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "ab"), (2, "WXYZ"), (3, None), (4, "LOUD TEXT")], "id int, text string")


def results(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_column_and_arrow_hooks(rows, hooks):
    assert results(hooks.applied(rows, "judge", "long", ["text"]), "judge") == {1: False, 2: True, 3: None, 4: True}
    assert results(hooks.applied(rows, "judge", "upper", ["text"], "loud"), "loud") == {1: False, 2: True, 3: None, 4: True}
    assert results(hooks.applied(rows, "verify", "known", ["text"]), "verify") == {1: True, 2: True, 3: False, 4: True}
    assert results(hooks.applied(rows, "acquire", "letters", ["text"]), "acquire")[1] == ["a", "b"]
    assert results(hooks.applied(rows, "spec", "joined", ["id", "text"]), "spec")[2] == "2-WXYZ"
    again = hooks.applied(hooks.applied(rows, "judge", "upper", ["text"]), "judge", "upper", ["text"])
    assert again.columns == ["id", "text", "judge"]


def test_absent_hooks_are_null_and_gated_ones_raise(rows, hooks):
    out = hooks.applied(rows, "judge", "nobody", ["text"])
    assert dict(out.dtypes)["judge"] == "boolean" and set(results(out, "judge").values()) == {None}
    with pytest.raises(Gated, match="no weights"):
        hooks.applied(rows, "predict", "gated", ["text"])
    assert results(hooks.applied(rows, "predict", "open", ["text"]), "predict")[1] == "AB"
    told = hooks.all_of(rows, "predict", ["open", "gated", "nobody"], ["text"]).groupBy("predict_name").agg(F.max("predict_reason"), F.count("predict"), F.count("*")).collect()
    assert {tuple(r) for r in told} == {("open", None, 3, 4), ("gated", "no weights", 0, 4), ("nobody", "absent", 0, 4)}


def test_hooks_that_are_wrong(rows, hooks):
    for kind, name, kinds in (("paint", "x", dict(column=lambda t: t)), ("judge", "long", dict(column=lambda t: t)), ("judge", "none", {}), ("judge", "both", dict(column=lambda t: t, arrow=lambda b: b))):
        with pytest.raises(ValueError):
            hooks.add(kind, name, **kinds)
    hooks.add("judge", "short", arrow=lambda b: pa.array([True], pa.bool_()))
    with pytest.raises(Exception, match="gave 1 results"):
        hooks.applied(rows.coalesce(1), "judge", "short", ["text"]).count()


def test_every_replicate_has_each_strata_at_its_size(spark):
    rng = np.random.default_rng(0)
    cells = [(s, p, float(v), int(rng.integers(1, 9))) for s in "ab" for p in range(3) for v in range(p * 5, p * 5 + (3 if s == "a" else 5))]
    df = spark.createDataFrame(cells, "stratum string, part int, value double, units long")
    draws = B.allotted(df.groupBy("stratum", "part").agg(F.sum("units").alias("size")), 1200, 3)
    sums = B.replicate_sums(df, draws, 3)
    size = {s: sum(u for t, _, _, u in cells if t == s) for s in "ab"}
    for r in sums.groupBy("stratum", "replicate").agg(F.sum("drawn").alias("n"), F.count("*").alias("parts")).collect():
        assert r["n"] == size[r["stratum"]] and r["parts"] == 3
    assert sums.select("replicate").distinct().count() == 1200
    # Counts have a multinomial's mean and spread.
    of = {p: np.array([r["drawn"] for r in sums.where(f"stratum = 'a' AND part = {p}").collect()]) for p in range(3)}
    for p, n in of.items():
        share = sum(u for t, q, _, u in cells if t == "a" and q == p) / size["a"]
        assert abs(n.mean() / size["a"] - share) < 0.02 and abs(n.var() / (size["a"] * share * (1 - share)) - 1) < 0.2


@pytest.mark.parametrize("kind", ["few values", "all different"])
def test_interval_equals_a_plain_bootstrap(spark, kind):
    rng = np.random.default_rng(7)
    strata = rng.choice(["x", "y", "z"], 400, p=[0.6, 0.3, 0.1])
    shift = {"x": 0.0, "y": 1.5, "z": -2.0}
    values = np.array([shift[s] for s in strata]) + (rng.integers(-1, 2, 400) if kind == "few values" else rng.normal(size=400))
    df = spark.createDataFrame(list(zip(strata.tolist(), values.tolist())) + [("x", None)], "s string, v double")
    got = B.stratified_bootstrap(df, "v", "s", 4000, 1, part_values=60).first()
    groups = [values[strata == s] for s in ("x", "y", "z")]
    boots = [np.concatenate([g[rng.integers(0, len(g), len(g))] for g in groups]).mean() for _ in range(4000)]
    low, high = np.percentile(boots, [2.5, 97.5])
    width = high - low
    assert abs(got["estimate"] - values.mean()) < 1e-12 and got["units"] == 400 and got["replicates"] == 4000
    assert abs(got["low"] - low) < 0.08 * width and abs(got["high"] - high) < 0.08 * width
    assert B.stratified_bootstrap(df.repartition(7), "v", "s", 4000, 1, part_values=60).first() == got  # the same draws however rows are dealt out
    loose = B.stratified_bootstrap(df, "v", None, 4000, 1).first()
    assert loose["high"] - loose["low"] > 1.15 * (got["high"] - got["low"])  # strata differ, so one pool varies more


def test_bootstrap_edges(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5 + [(None, 2.0)], "s string, v double")
    assert tuple(B.stratified_bootstrap(df, "v", "s", 100).first()) == (2.0, 2.0, 2.0, 6, 100)
    assert tuple(B.stratified_bootstrap(df.where("false"), "v", "s", 100).first()) == (None, None, None, 0, 0)


def test_reduced_fields_equal_the_full_measurement(spark):
    rng = np.random.default_rng(4)
    for n in (3, 9, 17):
        axis = np.linspace(0, 1, n)
        identity = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1)
        tables = np.stack([identity, identity**1.3, identity * 0.8 + 0.1, np.clip(identity * 1.4 - 0.2, 0, 1), rng.random(identity.shape), np.zeros(identity.shape), identity[..., ::-1]])
        got = M.reduced(tables)
        assert tuple(got) == M.REDUCED and set(M.REDUCED) <= set(M.FIELDS)
        for k, table in enumerate(tables):
            full = M.measured(table)
            assert all(abs(got[f][k] - full[f]) < 1e-10 for f in M.REDUCED), (n, k)
    mixed = [(1, 9, np.full(9**3 * 3, 0.5).tolist()), (2, 3, np.linspace(0, 1, 81).tolist()), (3, 9, np.linspace(0, 1, 2187).tolist())]
    rows = {r["id"]: r for r in M.reduced_behavior(spark.createDataFrame(mixed, "id int, n int, values array<double>"), "id").collect()}
    for k, n, v in mixed:
        full = M.measured(np.array(v).reshape(n, n, n, 3))
        assert all(abs(rows[k][f] - full[f]) < 1e-10 for f in M.REDUCED)
