"""Every query with SQL gives the SQL's rows on the smallest tables."""

import pytest

from planeframe.llm.registry import ORACLES, QUERIES

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLES[name])
