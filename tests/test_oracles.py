"""Registered queries against their oracle SQL on the smallest tables."""

import pytest
from compare import compare

from provlake.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, name):
    assert compare(spark, name, SF) is None


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
