"""Tables with repeated keys and odd rows: queries and their SQL state the same rule there."""

import duckdb
from oracle import same

from gleaner import registry


def lineitem(tmp_path, select):
    duckdb.sql(f"COPY ({select}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    return c


def test_hue_sector_keeps_equal_line_items(spark, tmp_path):
    c = lineitem(tmp_path, "SELECT i // 2 AS l_orderkey, 1 AS l_linenumber, 3 + i // 2 AS l_partkey, (1 + i // 2)::DOUBLE AS l_quantity, 0.02::DOUBLE AS l_discount FROM range(20) t(i)")
    got = registry.QUERIES["hue_sector"](spark, str(tmp_path)).toPandas()
    assert len(got) == 20
    same(got, c.sql(registry.SQL["hue_sector"]).df())


def test_family_tails_means_on_the_limit_are_not_over_it(spark, tmp_path):
    """Each table's quantities have the mean 25, a difference of exactly 5: no table is over, whatever the order of its rows."""
    c = lineitem(tmp_path, "SELECT s AS l_suppkey, i * 7 + s AS l_partkey, (CASE WHEN i % 2 = 0 THEN 25 + (i // 2 * 11 + s) % 25 ELSE 25 - (i // 2 * 11 + s) % 25 END)::DOUBLE AS l_quantity FROM range(70) a(s), range(600) b(i)")
    got = registry.QUERIES["family_tails"](spark, str(tmp_path)).toPandas()
    assert got["over"].sum() == 0 and (got["mean"] == 5).all()
    same(got, c.sql(registry.SQL["family_tails"]).df())
