import pytest

from histria import plans

from .compare import DATA, assert_same, has_data

pytestmark = pytest.mark.skipif(not has_data(), reason="no test tables")
#: Their SQL names fixed ids of the larger tables.
SKIP = set()


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(plans.QUERIES[name](spark, DATA), plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
