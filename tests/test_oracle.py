"""Differential test: every registered query against its DuckDB oracle on
sf0.01 (row count, column names, order-insensitive exact values)."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

from tests.conftest import SF_ORACLE

TABLES = "region nation customer supplier part orders lineitem events".split()
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(_norm(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return con


def _names():
    from tillroll.plans.oracle import ORACLE
    return sorted(ORACLE)


@pytest.mark.skipif(not os.path.exists(SF_ORACLE), reason="driver data missing")
@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, SF_ORACLE)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(oracle_sql()[name])
    otypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    res = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == otypes
    assert len(rows) == len(orows)
    assert rows, "fixture should not be empty"
    assert _canon(df.columns, rows) == _canon(ocols, orows)


def test_every_query_has_an_oracle():
    from tillroll.plans.oracle import ORACLE
    from tillroll.plans.queries import QUERIES
    assert set(QUERIES) == set(ORACLE)
