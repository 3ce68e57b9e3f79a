import pytest

from shoptide.llm.oracles import ORACLES
from shoptide.llm.queries import QUERIES
from tests.compare import differences
from tests.llm.data import FOLDER


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_statement(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER) is None
