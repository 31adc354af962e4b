"""Every query that has SQL, against it, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith("op") and n != "pipeline"))
def test_smoke(spark, name):
    """That it runs, no more; what these queries give is held in the other files."""
    assert QUERIES[name](spark, SF).count() >= 0
