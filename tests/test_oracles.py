"""Every registered query of the engine against its SQL on the smallest tables; those without SQL at least run."""

import pytest

from tessera import catalogue
from tests import oracles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracles.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    query, sql = catalogue.queries()[name], catalogue.oracle_sql().get(name)
    if sql:
        assert oracles.compare(spark, con, query, sql, SF) is None
    else:
        query(spark, SF).count()


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0
