"""Queries against their SQL twins."""

import pytest

from tools.check_oracle import compare
from watchloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(spark, duck, sf_dir, key):
    assert compare(duck, QUERIES[key](spark, sf_dir), ORACLES[key]) is None


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
