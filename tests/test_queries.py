"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from fieldspark.plans.catalog import QUERIES, SQL
from fieldspark.sources import TABLES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _value(x):
    if isinstance(x, float):
        return x + 0.0
    return int(x) if hasattr(x, "as_tuple") and x == int(x) else x


def _rows(rows):
    return sorted((tuple(map(_value, r)) for r in rows), key=lambda r: [(str(type(x)), str(x)) for x in r])


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == columns
    got = _rows(tuple(r[c] for c in columns) for r in df.collect())
    own = list(rel.columns)
    assert got == _rows(tuple(r[own.index(c)] for c in columns) for r in rel.fetchall())
