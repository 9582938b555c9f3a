"""Every query of the engine against its SQL on the smallest tables."""

import pytest
from conftest import SMALL

from parcelar.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, SMALL), ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
