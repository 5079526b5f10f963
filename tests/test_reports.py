"""Kernels of the reports against plain Python and hand-made answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.plans import reports as R


def test_plane_r2_is_least_squares(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], {}
    for image in range(4):
        x, y = rng.random(60), rng.random(60)
        r = rng.random(60) + image * x - 0.5 * image * y
        a = np.stack([np.ones(60), x, y], axis=1)
        left = r - a @ np.linalg.lstsq(a, r, rcond=None)[0]
        expected[image] = 1 - (left**2).sum() / ((r - r.mean()) ** 2).sum()
        rows += [(image, *map(float, v)) for v in zip(x, y, r)]
    rows += [(4, float(i % 5), float(i), 0.25) for i in range(20)]  # a constant residual
    rows += [(5, float(i), 2.0, 3.0 * i) for i in range(20)]  # places on one line
    rows += [(6, 1.0, 2.0, float(i)) for i in range(20)]  # one place
    expected |= {4: 0.0, 5: 1.0, 6: 0.0}
    got = spark.createDataFrame(rows, "image int, x double, y double, r double").groupBy("image").agg(R.plane_r2("x", "y", "r").alias("v")).collect()
    assert {g.image: round(g.v, 9) for g in got} == {k: round(v, 9) for k, v in expected.items()}


def plain_hinted(rows, hints, k):
    taken = []
    for hint in hints:
        if len(taken) < k:
            taken += [(i, hint) for i, text in rows if hint in text and i not in [t[0] for t in taken]][:1]
    taken += [(i, None) for i, _ in rows if i not in [t[0] for t in taken]]
    return taken[:k]


@pytest.mark.parametrize("k", [0, 2, 4, 30])
def test_hinted_examples(spark, k):
    rows = [(i, t) for i, t in enumerate(["plain", "warm", "warm cold", "cold", "cold warm", "other", "x"])]
    hints = ("warm", "cold", "warm", "absent", "warm cold")
    got = R.hinted(spark.createDataFrame(rows, "id int, spec string"), "spec", hints, k).collect()
    assert [tuple(g) for g in got] == plain_hinted(rows, hints, k)


def test_hinted_examples_of_no_rows(spark):
    assert R.hinted(spark.createDataFrame([], "id int, spec string"), "spec", ("warm",), 3).count() == 0


@pytest.mark.parametrize("raw, text", [
    (None, None), ("", None), ("  \t", None), (" plain ", "plain"), ('{"content": "c", "text": "t"}', "t"), ('{"text": "  ", "prompt": "p"}', "p"), ('{"b": 1, "z": "last", "a": "first"}', "last"),
    ('{"b": 1}', '{"b": 1}'), ('["one", "two"]', "one"), ("[1]", "[1]"), ("[]", "[]"), ("{oops", "{oops"), ('{"text": null, "user_want": "w"}', "w"),
])
def test_instruction_text(spark, raw, text):
    frame = spark.createDataFrame([(raw,)], "raw string").select(R.instruction_text(F.trim(F.regexp_replace("raw", "\t", " "))).alias("t"))
    assert frame.first().t == text


def notebook(*outputs, kind="code"):
    return json.dumps({"cells": [{"cell_type": kind, "outputs": list(outputs)}]})


@pytest.mark.parametrize("content, expected", [
    (notebook({"text": ["METRIC=1\n", "metric = 2.5e1"]}), ("ok", 25.0, 0)),
    (notebook({"text": "METRIC=3\n[sft][ABORT] no rows"}), ("failed", 3.0, 1)),
    (notebook({"text": "METRIC=3"}, kind="markdown"), ("no_metric", None, 0)),
    (notebook({"data": {"text/plain": ["METRIC=", "4"]}}), ("ok", 4.0, 0)),
    (notebook({"output_type": "error", "ename": "E", "evalue": "METRIC=5"}), ("ok", 5.0, 0)),
    ('{"cells": [{"cell_type": "code"}]}', ("no_metric", None, 0)), ("{}", ("no_metric", None, 0)), ("not json", ("no_metric", None, 0)), (None, ("no_metric", None, 0)),
])
def test_notebook_metric(spark, content, expected):
    assert tuple(spark.createDataFrame([(content,)], "c string").select(R.notebook_metric(F.col("c")).alias("m")).first().m) == expected


@pytest.mark.parametrize("prompt, target, most", [([1, 2, 3], [7, 8], 10), ([1, 2, 3], [7, 8, 2], 5), ([1, 2, 3], [7, 8, 9, 6], 4), ([], [], 3), ([1, 2], [], 0)])
def test_example_keeps_the_target(spark, prompt, target, most):
    whole = target if target and target[-1] == 2 else target + [2]
    room = max(0, most - len(whole))
    tail = prompt[-room:] if room else []
    got = spark.createDataFrame([(prompt, target)], "p array<bigint>, t array<bigint>").select(R.example(F.col("p"), F.col("t"), F.lit(2).cast("long"), most).alias("e")).first().e
    assert (got.input_ids, got.labels) == (tail + whole, [R.IGNORED] * len(tail) + whole)


@pytest.mark.parametrize("unit", [None, ""])
def test_strict_holdout_needs_a_unit(spark, unit):
    with pytest.raises(Exception, match="no split unit"):
        spark.createDataFrame([("u",), (unit,)], "unit string").select(R.strict_held_out(F.col("unit"), 0.1)).collect()


def test_strict_holdout_of_named_units(spark):
    from gleaner.functions.hashing import held_out

    rows = spark.range(200).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("unit"))
    assert rows.where(R.strict_held_out(F.col("unit"), 0.1) != held_out(F.col("unit"), 0.1)).count() == 0
