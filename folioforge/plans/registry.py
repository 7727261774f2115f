"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL for the same rows."""

    def put(function: Callable) -> Callable:
        name = function.__name__
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return put
