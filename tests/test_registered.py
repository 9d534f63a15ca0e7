"""Every registered query gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    ok, detail = compare(
        spark, duck, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR
    )
    assert ok, detail


def test_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["user_id", "bucket", "points"]
    assert result.count() > 0
