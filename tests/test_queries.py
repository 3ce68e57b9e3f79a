import pytest

import __spark_entry__ as contract
from tests.compare import differences

FOLDER = "/root/testdata/sf0.001"


OWN = sorted({**contract.BATCH_QUERIES, **contract.STREAM_QUERIES})


@pytest.mark.parametrize("name", OWN)
def test_query_equals_oracle(spark, name):
    assert differences(contract.queries()[name](spark, FOLDER), contract.oracle_sql()[name], FOLDER) is None


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
