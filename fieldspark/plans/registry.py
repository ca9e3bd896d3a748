"""A registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(column: Column | str, digits: int = 4) -> Column:
    """Rounded, with no negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


#: The field of the events in SQL: by class, and summed over classes.
FIELD = "f AS (SELECT event_type AS class, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) + 1 AS state, user_id AS label, sum(value) AS value FROM events GROUP BY ALL)"
TOTAL = "f AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) + 1 AS state, user_id AS label, sum(value) AS value FROM events GROUP BY ALL)"
DENSE = TOTAL + ", g AS (SELECT s.state, l.label, coalesce(f.value, 0.0) AS value FROM (SELECT unnest(range(1, 31)) AS state) s CROSS JOIN (SELECT DISTINCT label FROM f) l LEFT JOIN f ON f.state = s.state AND f.label = l.label)"
STATES = 30


def vector_sql(names: tuple[str, ...], first: int = 1) -> str:
    return "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{first + i}] AS DOUBLE) AS {n}" for i, n in enumerate(names)) + " FROM embeddings"
