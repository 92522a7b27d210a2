"""Every registered query of the reference operators against its DuckDB oracle, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quillon import catalogue, plans  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        v = v.tolist()
    if isinstance(v, list):
        return str([_cell(x) for x in v])
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal" else str(v)


def _rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert len(found) > 0
    if name in catalogue.ORACLES:
        assert _rows(found) == _rows(duck.sql(catalogue.ORACLES[name]).df())
