"""All evaluation queries and their SQL twins."""

from __future__ import annotations

from . import report_queries, scoring_queries, stream_queries, table_queries, tree_queries  # noqa: F401  they register
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
