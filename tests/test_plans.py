"""Plans at a glance: no cartesian products, and scans that read only what a query needs."""

import re

import pytest

from gleaner import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not re.match("components|farthest|pca|cosine", n)))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(registry.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name, columns", [("per_category_recall", {"doc_id", "source", "lang", "n_chars", "quality", "toxic"}), ("percentile_stats", {"l_returnflag", "l_quantity"}), ("html_links", {"page_id", "html"}), ("dominance_check", {"source"}), ("resume_pending", {"doc_id", "conv_id", "role", "turn", "text"})])
def test_scans_read_few_columns(spark, name, columns):
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan(registry.QUERIES[name](spark, SF))))))
    assert read and read <= columns


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*o_orderstatus", plan(registry.QUERIES["connector_caps"](spark, SF)))
