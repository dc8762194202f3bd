"""Every graph query against its SQL on DuckDB, and the entry module."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__
from knotwork import file_queries, queries

QUERIES, ORACLE_SQL = queries.QUERIES | file_queries.QUERIES, queries.ORACLE_SQL | file_queries.ORACLE_SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark, small, request):
    """Columns and rows of the queries to be tested. Some run at a time: on so small tables, most of a query is waiting for its jobs to start."""

    def rows(name):
        df = QUERIES[name](spark, small)
        columns = sorted(df.columns)
        return columns, sorted(tuple(map(same, r)) for r in df.select(*columns).collect())

    wanted = [item.callspec.params["name"] for item in request.session.items if item.name.startswith("test_query[")]
    pool = ThreadPoolExecutor(6)
    yield {name: pool.submit(rows, name) for name in wanted}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, duck, name):
    names, found = results[name].result()
    columns = ", ".join(f'"{c}"' for c in names)
    expected = sorted(tuple(map(same, r)) for r in duck.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]}) q").fetchall())
    assert found == expected
    assert found


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
