"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle import compare, connect

from waymark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.SQL:
        message, _n = compare(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF)
        assert message == ""
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_every_twin_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
