"""Every query with SQL against that SQL, and the driver's entry points."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pantry import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def rows(frame):
    def plain(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)

    names = sorted(frame["columns"])
    return sorted(tuple(plain(r[frame["columns"].index(n)]) for n in names) for r in frame["rows"])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    got = {"columns": df.columns, "rows": [tuple(r) for r in df.collect()]}
    sql = duck.sql(queries.ORACLE_SQL[name])
    expected = {"columns": sql.columns, "rows": sql.fetchall()}
    assert sorted(got["columns"]) == sorted(expected["columns"])
    assert rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(monkeypatch):
    monkeypatch.setattr(entry, "llm_queries", None)
    assert set(entry.queries()) == set(queries.QUERIES)
