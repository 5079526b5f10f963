"""Runs DuckDB SQL over the same tables and compares rows without order."""

import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and math.isnan(v)):
        return "null"
    if isinstance(v, (np.ndarray, list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 5) + 0.0)
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def same(got, expected):
    a, b = rows(got), rows(expected)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    differ = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not differ, differ[:3]
