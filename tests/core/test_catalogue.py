"""Every catalogue query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from chunkweave.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def text(df):
    return sorted(tuple("null" if x is None or x != x else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    want, got = duck.sql(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and text(want) == text(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_slice_plan(spark):
    """Filter, projection and partial aggregation over a scan of four columns: no Python, one shuffle for the array and one for the files."""
    plan = QUERIES["slice_refs_per_file"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 2 and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double>" in plan
