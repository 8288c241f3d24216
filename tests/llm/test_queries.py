"""Registered queries of the training-data operators against their SQL, on the smallest tables."""

import duckdb
import pytest

from check_oracle import TABLES, rows, types
from disputatio.llm.queries import all_oracles, all_queries


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, small, con, name):
    got = all_queries()[name](spark, small).toArrow()
    want = con.execute(all_oracles()[name]).to_arrow_table()
    assert got.num_rows > 0
    assert rows(got) == rows(want)
    assert types(got) == types(want)
