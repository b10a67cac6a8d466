"""The corpus queries that SQL can express, against DuckDB on the smallest tables."""
import duckdb
import pytest

from tesseral.llm import queries

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = c.execute(queries.ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(k)] for k in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r[k] for k in cols) for r in df.collect()), key=str) == want
