import pytest

from gridhead.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import SF
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    rows, *differ = differences(spark, QUERIES[name], ORACLES[name], SF)
    assert rows > 0 and differ == [0, 0]
