"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run and give rows."""

import datetime
import decimal
import math

import duckdb
import pytest

from folioforge.plans import catalogue
from folioforge.tables import TABLES

SF = "/root/testdata/sf0.001"


def canon(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 5)
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_equal_sql(spark, duck, name):
    made = catalogue.QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert columns == sorted(want.columns)
    rows = sorted(repr(canon(tuple(r))) for r in made.select(*[f"`{c}`" for c in columns]).collect())
    expected = sorted(repr(canon(r)) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
