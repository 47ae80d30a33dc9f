"""Every named query against DuckDB on the sf0.01 tables."""

import pytest
from oracle_check import connect, oracle_rows, spark_rows

import __spark_entry__ as entry_points
from tidemart.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry_points.oracle_sql())


def test_entry_runs(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["log_date", "log_hour", "ct"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = spark_rows(entry_points.queries()[name](spark, SF))
    want = oracle_rows(duck, entry_points.oracle_sql()[name])
    assert want[1], "the oracle result must not be empty"
    assert got == want
