"""Every query of the library against its SQL."""

import pytest

from orrery.plans import catalog
from tests.oracle import both

ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.SQL))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf, name):
    names, mine, their_names, theirs = both(spark, sf, catalog.QUERIES[name], catalog.SQL[name])
    assert names == their_names
    assert mine == theirs


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
