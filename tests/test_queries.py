"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tessera import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) or hasattr(value, "as_tuple"):
        return "nan" if math.isnan(value) else repr(round(float(value), 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, sf, db, name):
    found = QUERIES[name](spark, sf)
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(row[columns.index(c)]) for c in order) for row in cursor.fetchall())
    got = sorted(tuple(plain(row[c]) for c in order) for row in found.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    found = QUERIES[name](spark, sf)
    rows = found.collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in found.columns)


def test_entry(spark):
    assert registry.entry(spark).count() > 0
