"""Every engine query against its SQL."""

import pytest

from emberflow.oracle import oracle_sql
from emberflow.queries import queries
from tests.oracle import assert_same, needs_data


@needs_data
@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries()[name], oracle_sql()[name])
