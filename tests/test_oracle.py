"""Every registered query against its DuckDB oracle on the smallest data."""

import json
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL, core

TABLES = ["events", "documents", "conversations", "labels"]


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(json.dumps([_norm(r[i]) for i in order], ensure_ascii=False, default=str) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", core(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, res.fetchall())


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


def test_every_query_has_oracle():
    assert core(E.queries()) == core(E.oracle_sql())


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", core(E.oracle_sql()))
def test_query_types_match_oracle(spark, con, name):
    s = dict(E.queries()[name](spark, SF_SMALL).dtypes)
    rel = con.sql(E.oracle_sql()[name])
    d = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in s.items()} == d
