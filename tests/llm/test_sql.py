"""Queries with SQL against that SQL, over whole tables."""

import duckdb
import pytest

from pantry.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    names = sorted(df.columns)
    got = sorted(str([r[c] for c in names]) for r in df.collect())
    assert got == sorted(str([r[sql.columns.index(c)] for c in names]) for r in sql.fetchall()) and got
