"""Every query of the library itself against its SQL oracle, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import SMALL, connection, difference

import __spark_entry__
from shelfmark.queries.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_listed():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
