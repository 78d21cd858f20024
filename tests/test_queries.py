"""Every query with SQL gives the same rows as DuckDB on the small tables."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from paperloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool | str):
        return value
    if isinstance(value, int | float):
        return round(float(value), 4)
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, Counter(tuple(map(plain, row)) for row in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, DATA).toPandas())
    assert got == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)):
        assert catalog.QUERIES[name](spark, DATA).count() >= 0
