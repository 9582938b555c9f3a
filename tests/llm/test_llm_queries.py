"""Queries over the training-data operators: SQL where there is some, columns and row counts elsewhere."""

import pytest
from conftest import SMALL

from parcelar.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, SMALL), ORACLES[name])


def test_registered():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_pii", "op3_sentencepiece", "op6_token_counts", "op7_jaccard_join", "op8_quality"])
def test_a_row_per_document(spark, name):
    assert QUERIES[name](spark, SMALL).count() == 200
