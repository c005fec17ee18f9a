"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from ledgerlark.plans.registry import QUERIES
from tests.compare import difference, duckdb_on

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duckdb_on(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    query, sql = contract.queries()[name], contract.oracle_sql()[name]
    assert difference(spark, connection, FOLDER, query, sql) is None


def test_flagship(spark):
    assert contract.entry(spark).count() == 10
