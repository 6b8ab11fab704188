"""The numbered queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from reelspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    key = lambda r: [(x is None, x if x is not None else 0) for x in r]
    assert sorted(([r[n] for n in names] for r in df.collect()), key=key) == sorted(([r[i] for i in at] for r in rel.fetchall()), key=key)
