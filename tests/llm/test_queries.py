import pytest

from plumbline.llm import queries
from tests.conftest import SMALL
from tests.parity import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    if name in queries.SQL:
        assert compare(spark, con, SMALL, queries.QUERIES[name], queries.SQL[name]) is None
    else:
        assert queries.QUERIES[name](spark, SMALL).count() >= 0
