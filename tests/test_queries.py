import pytest

from planeframe.plans.catalog import ORACLES, QUERIES

from .oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLES[name])


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
