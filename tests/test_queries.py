"""Every query with SQL gives DuckDB's rows, and the plans look as they should."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from linkloom.plans.queries import ORACLES, QUERIES, selection_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, float) else v


def table(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def same(spark, duck, run, sql):
    got = run(spark, SF)
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = table(got.columns, got.collect())
    assert rows == table(columns, want.fetchall())
    return rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert same(spark, duck, QUERIES[name], ORACLES[name])


SMALL = selection_queries(quota=3, target=20, per_source=4)


@pytest.mark.parametrize("name", sorted(SMALL))
def test_limits_that_cut(spark, duck, name):
    """The same queries with limits below the table's size."""
    assert same(spark, duck, *SMALL[name])


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    quota = plan(QUERIES["quota_select"](spark, SF))
    assert quota.count("WindowGroupLimit") == 2  # a cut before the shuffle and one after
    assert "ReadSchema: struct<url:string>" in quota
    assert "Python" not in plan(QUERIES["v0_bit_length"](spark, SF))
    assert "LeftSemi" in plan(QUERIES["semi_join_ranked"](spark, SF))
    assert "CartesianProduct" not in plan(QUERIES["ppm_ideal_bits"](spark, SF))
