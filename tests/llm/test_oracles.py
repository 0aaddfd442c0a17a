"""The queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from adspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = queries.queries()[name](spark, SF)
    rel = c.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [list(rel.columns).index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
