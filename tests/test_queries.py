"""Every query against its SQL in DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pandas as pd
import pytest

from stockwright.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "~"
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return str(v)


def rows(df):
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def is_ordered(sql):
    """Whether the rows of the outermost SELECT are ordered."""
    outer, depth = "", 0
    for ch in sql:
        depth += (ch == "(") - (ch == ")")
        outer += ch if depth == 0 else " "
    return "ORDER BY" in outer.rsplit("SELECT", 1)[-1]


@pytest.mark.parametrize("name", sorted(n for n, sql in catalogue.ORACLE_SQL.items() if is_ordered(sql)))
def test_order_is_that_of_sql(spark, duck, name):
    """Rows come in the order that the SQL states, not only the same rows."""
    ours, theirs = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    listed = lambda df: [tuple(map(_cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    assert listed(ours) == listed(theirs)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0
