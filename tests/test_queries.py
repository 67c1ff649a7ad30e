"""Every registered query runs at the smallest scale and agrees with its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.plans import registry
from factloom.plans.fixtures import BASE_TABLES

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = registry.queries(), registry.check_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if hasattr(value, "isoformat") else value


def ordered(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = ordered(df.columns, df.collect())
    if name in CHECKS:
        cursor = con.execute(CHECKS[name])
        assert result == ordered([d[0] for d in cursor.description], cursor.fetchall())
    else:
        assert result[1]


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
