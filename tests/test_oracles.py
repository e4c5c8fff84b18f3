"""Every query with SQL against DuckDB, on the smallest tables."""

import numbers

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry
from tessera.session import TABLES

SF = "/root/testdata/sf0.001"


def norm(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "null" if pd.api.types.is_scalar(v) and pd.isna(v) else repr(round(float(v), 5)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
