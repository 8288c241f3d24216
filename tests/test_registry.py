"""Every registered query runs on the smallest tables; where SQL exists, both results are equal."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import TABLES, rows, types

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, small, con, name):
    got = queries()[name](spark, small).toArrow()
    assert got.num_rows > 0
    if name in oracle_sql():
        want = con.execute(oracle_sql()[name]).to_arrow_table()
        assert rows(got) == rows(want)
        assert types(got) == types(want)


def test_entry(spark):
    assert entry(spark).count() > 0
