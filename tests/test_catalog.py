"""Every query that has SQL against it, on the smallest tables."""

import pytest

from basalt.plans import catalog
from tests.oracle import SF, from_spark, from_sql


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = from_spark(catalog.queries()[name](spark, SF))
    if name in catalog.oracle_sql():
        names, want = from_sql(catalog.oracle_sql()[name])
        assert got[0] == names
        assert not got[1] - want and not want - got[1]


def test_every_query_has_sql():
    # The machine's facts are no query of the tables.
    assert set(catalog.queries()) - {"engine_facts"} == set(catalog.oracle_sql())
