"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_oracle import TABLES, _rows
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and all(0.45 <= r.confidence <= 0.99 for r in rows)
    assert all("▇▇▇" in r.excerpt and len(r.excerpt) <= 70 for r in rows)
    assert not [r for r in rows if r.category == "self-harm" and r.direction != "outgoing"]


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    result = duck.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, result.fetchall())
