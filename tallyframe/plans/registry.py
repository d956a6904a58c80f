"""Queries by name, each with its SQL twin where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Twins over literal rows, for the tests: what the tables can't show. Not queries.
LITERALS: dict[str, tuple[Query, str]] = {}


def literal(name: str, sql: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        LITERALS[name] = (run, sql)
        return run

    return register


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register
