import pytest

from hushframe import catalog
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql_twin(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name])


def test_names_are_known():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
