"""Every query of the library against the SQL it stands for, over the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from tallyspark import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    rows = catalogue.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    answer = duck.execute(SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr) == sorted(want, key=repr)


def test_every_query_without_sql_gives_rows(spark):
    for name in sorted(set(catalogue.queries()) - set(SQL)):
        assert catalogue.queries()[name](spark, SF).columns
