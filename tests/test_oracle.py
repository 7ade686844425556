"""Every core query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

from memloom.plans import registry
from tests.oracle import difference, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, con, sf_dir, name):
    assert difference(spark, con, registry.QUERIES[name], registry.SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.count() > 0
