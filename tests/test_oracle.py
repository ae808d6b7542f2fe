"""Every named query against its SQL twin."""

import pytest

from tools.check_oracle import compare
from watchloom.plans import ORACLES, QUERIES


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, sf_dir, key):
    assert compare(duck, QUERIES[key](spark, sf_dir), ORACLES[key]) is None
