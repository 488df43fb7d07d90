"""Registry of the graph queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.sources.fixture import GRAPH_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return put


def on_graph(sql: str, recursive: str = "") -> str:
    """SQL behind the graph's table expressions; `recursive` are further expressions."""
    return f"WITH RECURSIVE {GRAPH_SQL.strip()}{', ' + recursive.strip() if recursive else ''}\n{sql.strip()}"
