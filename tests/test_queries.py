"""Every query with an oracle against DuckDB on the smallest tables."""

import datetime
from decimal import Decimal

import duckdb
import pytest

from tarnflow.oracle import ORACLE_SQL
from tarnflow.queries import QUERIES

from .conftest import SF

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def cell(v):
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(float(v)) if isinstance(v, (float, Decimal)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    ours = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted(tuple(cell(r[k]) for k in at) for r in rel.fetchall())
    assert ours == theirs


def test_second_retail_run_adds_nothing(spark):
    rows = QUERIES["retail_end_to_end"](spark, SF).collect()
    assert len(rows) == 10 and all(r.rows > 0 for r in rows if "quarantine" not in r.table) and all(r.added_by_second_run == 0 for r in rows)


def test_filters_and_columns_reach_the_scan(spark):
    from tarnflow.queries import read

    plan = read(spark, SF, "orders").where("o_totalprice > 1000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
