"""Every core query against its SQL on the smallest tables."""

import pytest

from seqlab.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1
