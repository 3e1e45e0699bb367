"""Every query by name, with the SQL that must give the same rows where there is such SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def iso(x: str) -> str:
    """SQL for ISO text of a timestamp, with microseconds only where they are not zero."""
    return f"(strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({x}) % 1000000 = 0 THEN '' ELSE strftime({x}, '.%f') END || '+00:00')"


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries; importing the modules registers them."""
    from chronicle.plans import event_queries, graph_queries, memory_queries, source_queries, store_queries, time_queries  # noqa: F401

    return QUERIES, SQL
