"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def ordered(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in at)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert df.columns
        return
    cursor = db.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(df.columns, got) == ordered(columns, cursor.fetchall())


def test_entry(spark, folder):
    assert contract.entry(spark).count() > 0
