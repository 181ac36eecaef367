"""Every registered query with an exact result equals its SQL counterpart."""

import pytest

import __spark_entry__ as entry_points
from tests.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_statement_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("key", list(entry_points.oracle_sql()))
def test_equals_sql(spark, connection, key):
    assert compare(spark, connection, SF_DIR, key) is None


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.count() > 0
    assert "CustomerSegment" in result.columns
