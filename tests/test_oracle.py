"""Every registered query with a SQL twin, compared on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


@pytest.fixture(scope="module")
def connection(small):
    return check_oracle.connect(small)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, connection, small, name):
    message, _ = check_oracle.compare(spark, connection, name, small)
    assert message.startswith("ok"), message


def test_entry_has_rows(spark, small):
    assert entry.entry(spark).count() == 11
