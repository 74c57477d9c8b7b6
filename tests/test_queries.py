"""Every registered query with SQL is held against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pandas as pd
import pytest

from orrerylake.jobs import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(f"{float(v):.10g}")
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    frame = registry.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted(str([plain(r[c]) for c in names]) for r in frame.collect())
    wanted = db.sql(registry.ORACLE_SQL[name])
    assert sorted(wanted.columns) == names
    at = [wanted.columns.index(c) for c in names]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in wanted.fetchall())


def test_fuzzy_keys(spark):
    got = {r.term: r.key for r in registry.QUERIES["m9_fuzzy_keys"](spark, SF).collect()}
    assert got == {"SPACECRAFT": "SPACECRAFT_NAME", "PRODUKT_ID": "PRODUCT_ID", "DESCRIBTION": "DESCRIPTION", "PRIZE": "PRICE", "BYTE": "BYTES", "PADED": "PADDED"}


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
