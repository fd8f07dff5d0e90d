"""Each query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from corpusward.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    made = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(made.columns)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, made.select(*columns).collect())) == sorted(want)
