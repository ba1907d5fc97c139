"""Every query with a SQL twin gives the same columns, types and rows as the twin."""

import pytest

from tools.check import compare, connect
from vigilog import catalog

QUERIES, TWINS = catalog.queries(), catalog.twins()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, sf, name):
    _, verdict = compare(spark, con, name, QUERIES[name], TWINS[name], sf)
    assert verdict.startswith("ok"), verdict


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)
