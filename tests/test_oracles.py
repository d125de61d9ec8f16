"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from corpuslens.plans import catalog
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    catalog.load()
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_flagship(spark):
    rows = entry.entry(spark).limit(5).collect()
    assert [r.debt_ratio for r in rows] == sorted((r.debt_ratio for r in rows), reverse=True)
