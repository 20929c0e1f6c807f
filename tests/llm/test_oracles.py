"""The training-data queries and their SQL, row by row, over whole tables."""

import pytest

from histria import llm

from ..compare import DATA, assert_same, has_data


@pytest.mark.skipif(not has_data(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(llm.QUERIES[name](spark, DATA), llm.ORACLES[name])
