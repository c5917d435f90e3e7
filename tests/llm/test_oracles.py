"""The operators' queries against their SQL, where SQL can express them."""

import pytest

from peakloom.llm import queries
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert differences(queries.queries()[name](spark, sf), sf, queries.oracle_sql()[name]) == ""
