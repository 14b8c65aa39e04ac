"""The registered queries next to their SQL twins."""

import os

import pytest
from oracle import compare, connect

from waymark.llm.queries import QUERIES, SQL

SF = os.environ.get("WAYMARK_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    message, rows = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert not message
    assert rows
