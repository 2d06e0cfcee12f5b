"""Every registered query against its SQL on another engine, whole results."""

import pytest
from compare import difference, reference_db

from tablecheck.plans import catalog


@pytest.fixture(scope="module")
def db(folder):
    return reference_db(folder)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, folder, db, key):
    assert difference(catalog.QUERIES[key](spark, folder), db, catalog.ORACLES[key]) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
