"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from stratarc.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and pd.isna(x)) or x is pd.NaT:
        return None
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    if hasattr(x, "__int__") and not isinstance(x, str) and float(x) == int(x):
        return str(int(x))
    return str(x)


def rows(df):
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    assert __spark_entry__.entry(spark).count() > 0
