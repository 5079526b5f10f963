"""Resampling, Hald images and colour management of tables against plain loops."""

import itertools

import numpy as np
import pytest

from gleaner.functions.color import adobe_to_srgb as adobe_columns
from gleaner.operators import grids as R
from gleaner.operators.measure import hald_table, read_png


def plain_at(table, point):
    """Trilinear interpolation at one colour."""
    n, out = table.shape[0], np.zeros(3)
    at = np.clip(point, 0, 1) * (n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    for bits in itertools.product((0, 1), repeat=3):
        weight = np.prod([f if b else 1 - f for b, f in zip(bits, at - low)])
        if weight:
            out += weight * table[tuple(low + np.array(bits))]
    return out


def plain_resampled(table, m):
    axis = np.linspace(0, 1, m)
    return np.array([plain_at(table, np.array(p)) for p in itertools.product(axis, repeat=3)]).reshape(m, m, m, 3)


@pytest.mark.parametrize("n, m", [(2, 5), (5, 4), (4, 9), (3, 3), (7, 2)])
def test_resampled(spark, n, m):
    rng = np.random.default_rng(n)
    tables = {k: rng.random((n, n, n, 3)) for k in range(3)} | {9: rng.random((n + 1,) * 3 + (3,))}  # sizes differ in a batch
    df = spark.createDataFrame([(k, t.shape[0], t.ravel().tolist()) for k, t in tables.items()], "id int, n int, values array<double>")
    got = {r["id"]: np.array(r["values"]).reshape(m, m, m, 3) for r in R.resampled(df, "id", m).collect()}
    assert got.keys() == tables.keys()
    assert all(np.abs(got[k] - plain_resampled(t, m)).max() < 1e-12 for k, t in tables.items())


def test_gather_and_spread(spark):
    nodes = [(k, r, g, b, r + 0.1 * k, g * 2.0, b * 3.0) for k in range(2) for r in range(3) for g in range(3) for b in range(3)]
    df = spark.createDataFrame(nodes, "id int, r int, g int, b int, x double, y double, z double").repartition(4)
    back = R.spread(R.gathered(df, "id", 3), "id").select("id", "r", "g", "b", "x", "y", "z")
    assert sorted(map(tuple, back.collect())) == sorted(nodes)


@pytest.mark.parametrize("n, level", [(4, 2), (9, 3), (16, 4), (5, None)])
def test_hald_round_trip(spark, n, level):
    rng = np.random.default_rng(7)
    tables = {k: rng.random((n, n, n, 3)) * 1.2 - 0.1 for k in range(2)}
    df = spark.createDataFrame([(k, n, t.ravel().tolist()) for k, t in tables.items()], "id int, n int, values array<double>")
    images = R.to_hald(df, "id", level)
    for r in images.collect():
        assert read_png(bytes(r["content"])).shape == (r["level"] ** 3,) * 2 + (3,)
    back = {r["id"]: np.array(r["values"]).reshape((r["n"],) * 3 + (3,)) for r in R.from_hald(images, "id").collect()}
    for k, t in tables.items():
        want = np.clip(R.resampled_to(t[None], back[k].shape[0])[0], 0, 1)
        assert np.abs(back[k] - want).max() <= 0.5 / 255 + 1e-12
    junk = spark.createDataFrame([(1, b"none"), (2, None), (3, R.png(np.zeros((5, 5, 3), np.uint8)))], "id int, content binary")
    assert R.from_hald(junk, "id").count() == 0


def test_png_is_read_back():
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (8, 8, 3)).astype(np.uint8)
    assert np.array_equal(read_png(R.png(pixels)), pixels)
    red = R.hald_image(np.stack(np.meshgrid(*[np.linspace(0, 1, 4)] * 3, indexing="ij"), axis=-1), 2)
    assert (red[0, :4, 0] == [0, 85, 170, 255]).all() and (red[0, :4, 1:] == 0).all()  # red is fastest
    assert np.array_equal(hald_table(red)[1, 2, 3], np.array([1, 2, 3]) / 3)


def test_colour_management_there_and_back(spark):
    rng = np.random.default_rng(5)
    rgb = rng.random((300, 3))
    assert np.abs(R.adobe_to_srgb(R.srgb_to_adobe(rgb)) - rgb).max() < 1e-6  # the wider space holds every sRGB colour
    assert np.allclose(R.srgb_to_adobe(np.ones((1, 3))), 1, atol=1e-3) and np.abs(R.srgb_to_adobe(np.zeros((1, 3)))).max() < 1e-12
    df = spark.createDataFrame(rgb.tolist(), "r double, g double, b double")
    columns = adobe_columns(df["r"], df["g"], df["b"])
    got = np.array(df.select(*[c.alias(n) for n, c in zip("rgb", columns)]).toPandas())
    assert np.abs(got - R.adobe_to_srgb(rgb)).max() < 1e-9  # columns and arrays agree


def test_canonical_tables(spark):
    axis = np.linspace(0, 1, 9)
    identity = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1)
    rows = [(1, 9, identity.ravel().tolist(), False), (2, 9, identity.ravel().tolist(), True), (3, 9, (identity * 1.5 - 0.2).ravel().tolist(), None)]
    got = {r["id"]: r for r in R.canonical(spark.createDataFrame(rows, "id int, n int, values array<double>, wide boolean"), "id", "wide", 5).collect()}
    assert np.abs(got[1]["residual"]).max() < 1e-12 and not got[1]["clipped"] and got[3]["clipped"]
    assert np.abs(got[2]["residual"]).max() < 1e-6  # the identity is itself in any space
    assert np.allclose(np.array(got[3]["values"]).reshape(5, 5, 5, 3), plain_resampled(np.clip(identity * 1.5 - 0.2, 0, 1), 5))
    rng = np.random.default_rng(1)
    table = rng.random((4, 4, 4, 3))
    out = R.managed(table, 3)
    for i, j, k in itertools.product(range(3), repeat=3):
        node = R.srgb_to_adobe(np.array([[i, j, k]]) / 2)[0]
        assert np.allclose(out[i, j, k], R.adobe_to_srgb(plain_at(table, node)[None])[0])
    assert len({r["residual_sha256"] for r in got.values()}) == 3


def test_tables_are_dense_in_bounded_numbers():
    import numpy as np
    import pandas as pd

    from gleaner.operators import grids as R

    part = pd.DataFrame({"n": [2, 9] * 500, "values": [np.arange(24.0), np.arange(2187.0)] * 500})
    seen = [(rows, found) for rows, found in R._dense(part, 17)]
    assert sorted(k for rows, _ in seen for k in rows) == list(range(1000))
    assert max(len(rows) for rows, _ in seen) * 3 * 17**3 <= R.AT_ONCE
    assert all(found.shape[1] == part["n"].iloc[k] for rows, found in seen for k in rows)
    assert max(len(rows) for rows, _ in R._dense(part.assign(n=2, values=[np.zeros(24)] * 1000), 200)) == 1
