"""Registered queries against their SQL on the smallest tables, and the rules that SQL can't express."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from assaymill.plans import queries as plans
from assaymill.plans import measure_queries, review_queries, rule_queries, search_queries, workflow_queries  # noqa: F401  they register more

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(plans.FOUND))
def test_query(spark, con, name):
    df = plans.FOUND[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in plans.SQL:
        want = con.sql(plans.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    else:
        assert got


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert row.total_weight > row.covered_weight > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
