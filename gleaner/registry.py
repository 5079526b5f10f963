"""All queries of the engine by name, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its own name."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


from .plans import acceptance, acquisition, admission, assembly, color, evaluation, grids, joins, measures, pictures, plugged, reports, selection, similarity, spec, splits, streams, stores, text, training  # noqa: E402, F401
