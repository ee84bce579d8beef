"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import os
from glob import glob

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(v).removesuffix(" 00:00:00"))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    got, want = plain(catalog.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(catalog.SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
