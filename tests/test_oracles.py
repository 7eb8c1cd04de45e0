"""Every registered query next to its oracle SQL at the smallest scale."""

import pytest

from compare import compare, duck
from likeness.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES.get(name), SF, name) is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
