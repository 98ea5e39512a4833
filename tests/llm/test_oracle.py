"""The training-data queries that have SQL, against it."""

import pytest

from seqlab.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])
