"""Every registered query runs on the smallest tables, and gives the rows of its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from plumbline.plans import catalog
from tests.conftest import SMALL
from tests.parity import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.SQL:
        assert compare(spark, con, SMALL, catalog.QUERIES[name], catalog.SQL[name]) is None
    else:
        df = catalog.QUERIES[name](spark, SMALL)
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())
