"""Incremental enrichment and the versioned table under it."""

import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators.enrich import Unresolved, enrich
from gleaner.sources.versions import commit, current, current_version, vacuum

SCHEMA = "id string, digest string, body string, supported boolean"


def rows(spark, pairs):
    return spark.createDataFrame([(k, None if b is None else f"h-{b}", b, b is not None) for k, b in pairs.items()], SCHEMA)


def measuring(seen):
    def measure(df):
        seen.append(sorted(r["id"] for r in df.collect()))
        return df.select("id", F.length("body").alias("size"))

    return measure


def sizes(df):
    return {r["id"]: (r["digest"], r["version"], r["size"]) for r in df.collect()}


def test_only_new_or_changed_rows_are_measured(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []
    one, report = enrich(rows(spark, {"a": "x", "b": "yy"}), path, "v1", measuring(seen))
    assert sizes(one) == {"a": ("h-x", "v1", 1), "b": ("h-yy", "v1", 2)} and (report.measured, report.reused, report.committed) == (2, 0, True)
    two, report = enrich(rows(spark, {"a": "x", "b": "other", "c": "z"}), path, "v1", measuring(seen))
    assert seen[-1] == ["b", "c"] and (report.measured, report.reused, report.removed) == (2, 1, 1)
    assert sizes(two) == {"a": ("h-x", "v1", 1), "b": ("h-other", "v1", 5), "c": ("h-z", "v1", 1)}
    before = current_version(spark, path)
    again, report = enrich(rows(spark, {"a": "x", "b": "other", "c": "z"}), path, "v1", measuring(seen))
    assert seen[-1] == [] and not report.committed and current_version(spark, path) == before and sizes(again) == sizes(two)
    _, report = enrich(rows(spark, {"a": "x", "c": "z"}), path, "v2", measuring(seen))
    assert seen[-1] == ["a", "c"] and sizes(current(spark, path)) == {"a": ("h-x", "v2", 1), "c": ("h-z", "v2", 1)}
    assert sizes(spark.read.parquet(before)) == sizes(two)  # older versions stay


def test_nothing_is_written_where_a_row_has_nothing_to_measure(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []
    enrich(rows(spark, {"a": "x"}), path, "v1", measuring(seen))
    before, calls = current_version(spark, path), len(seen)
    with pytest.raises(Unresolved, match="1 rows"):
        enrich(rows(spark, {"a": "new", "b": None}), path, "v1", measuring(seen))
    assert len(seen) == calls and current_version(spark, path) == before
    out, report = enrich(rows(spark, {"a": "new", "b": None}), path, "v1", measuring(seen), unneeded="NOT supported")
    assert sizes(out) == {"a": ("h-new", "v1", 3)} and report.measured == 1


def test_a_measuring_that_loses_rows_or_fails_leaves_the_table(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []
    enrich(rows(spark, {"a": "x"}), path, "v1", measuring(seen))
    with pytest.raises(ValueError, match="results came"):
        enrich(rows(spark, {"a": "x", "b": "y", "c": "z"}), path, "v1", lambda df: df.where("id = 'b'").select("id", F.lit(1).alias("size")))
    with pytest.raises(Exception):
        enrich(rows(spark, {"b": "y"}), path, "v1", lambda df: df.select("id", F.raise_error(F.lit("no")).cast("int").alias("size")))
    with pytest.raises(ValueError, match="other columns"):
        enrich(rows(spark, {"a": "x", "b": "y"}), path, "v1", lambda df: df.select("id", F.lit(1).alias("width")))
    assert sizes(current(spark, path)) == {"a": ("h-x", "v1", 1)}


def test_versions_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "v")
    assert current(spark, path) is None
    for n in (1, 2, 3, 4):
        assert commit(spark.range(n), path).count() == n
    os.makedirs(f"{path}/v000005-torn")  # of a run that died before its pointer
    assert current(spark, path).count() == 4
    assert vacuum(spark, path, keep=1) == 3
    assert sorted(n[:7] for n in os.listdir(path) if n.startswith("v")) == ["v000003", "v000004"] and current(spark, path).count() == 4


def test_empty(spark, tmp_path):
    out, report = enrich(rows(spark, {"a": "x"}).where("false"), str(tmp_path / "t"), "v1", measuring([]))
    assert out.count() == 0 and report.committed
