"""Every registered query of the engine against its SQL in DuckDB, over whole tables."""

import pytest

from compare import differ
from mnemospark import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf, name):
    assert differ(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
