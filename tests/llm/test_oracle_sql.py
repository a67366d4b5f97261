"""Queries that SQL can express, against DuckDB."""

import compare
import pytest

from harborline.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_oracle(spark, sf_small, name):
    types, rows = compare.spark_result(queries.queries()[name](spark, sf_small))
    assert (types, rows) == compare.oracle(compare.connect(sf_small), oracle.oracle_sql()[name])
    assert rows
