"""Every query of the linear-algebra and benchmark operators against its SQL on the driver's small tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from weftline.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["i", "y"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) == set(ORACLES) <= set(__spark_entry__.queries())
