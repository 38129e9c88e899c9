"""Every query of the engine against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from pixloom import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shape(df):
    cols = sorted(df.columns)
    return df[cols].map(lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = shape(Q.queries()[name](spark, SF).toPandas()), shape(duck.sql(Q.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(Q.queries().keys() - Q.oracle_sql().keys()))
def test_runs_twice_alike(spark, name):
    df = Q.queries()[name]
    assert shape(df(spark, SF).toPandas()).equals(shape(df(spark, SF).toPandas()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
