import compare
import pytest

from judgeloom.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf, con, name):
    assert compare.differences(registry.queries()[name](spark, sf), registry.oracle_sql()[name], con) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500
    assert set(registry.queries()) <= set(__spark_entry__.queries())
