"""The training-data queries that SQL can express against it."""

import pytest

from emberflow.llm.oracle import oracle_sql
from emberflow.llm.queries import queries
from tests.oracle import assert_same, needs_data


@needs_data
@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries()[name], oracle_sql()[name])
