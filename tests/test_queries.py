"""Every registered query of the engine against its SQL, on the smallest test tables."""

import pytest

from compare import connection, same_rows
from lodestone.plans import analytics, cells, checks, extras, methods, relational, vectors  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    same_rows(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
