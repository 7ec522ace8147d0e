"""Every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import registry
from tools.check import TABLES, norm

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.ORACLE)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
