"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from chronoweave.plans import catalogue
from chronoweave.sources.fixtures import TABLES
from tests.conftest import data_dir


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{data_dir()}/{name}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, data_dir())
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, data_dir()).columns
