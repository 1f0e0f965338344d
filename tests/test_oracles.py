"""Every registered query runs; those with an oracle return what DuckDB returns."""

import os

import duckdb
import pandas as pd
import pytest

from tintframe.plans import catalogue

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("part", "lineitem", "supplier", "events", "embeddings", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def in_order(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_duckdb(spark, duck, name):
    ours = in_order(catalogue.QUERIES[name](spark, SMALL).toPandas())
    theirs = in_order(duck.sql(catalogue.ORACLES[name]).df())
    assert len(ours) > 0
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, check_exact=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLES.keys()))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert catalogue.ORACLES.keys() <= catalogue.QUERIES.keys()
    assert catalogue.FLAGSHIP in catalogue.QUERIES
