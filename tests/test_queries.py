"""Every registered query beside its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_queries as check  # noqa: E402
from shroudline import plans  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    line, good = check.compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert good, line


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
