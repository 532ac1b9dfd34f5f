"""Every registered query at the smallest scale, next to its SQL twin."""

from __future__ import annotations

import math

import duckdb
import pytest
from tests.conftest import SMALL

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return str(v)[:26] if hasattr(v, "isoformat") else repr(v) if isinstance(v, float) else str(v)


def _table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = _table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert got[1]
        return
    cur = duck.execute(ORACLE[name])
    assert got == _table([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["ts", "x", "y", "value"]
