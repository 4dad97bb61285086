import pytest

from hushframe.llm import registry
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql_twin(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLES[name])
