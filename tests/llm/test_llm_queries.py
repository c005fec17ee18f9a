"""Registered queries of the training-data operators against their SQL."""

from __future__ import annotations

import pytest

from ledgerlark.llm.queries import ORACLES, QUERIES
from tests.compare import difference, duckdb_on

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duckdb_on(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    assert difference(spark, connection, FOLDER, QUERIES[name], ORACLES[name]) is None
