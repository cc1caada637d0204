"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from conftest import DATA

from papyra.plans import registry

SLOW = {"louvain_communities"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_runs(name, spark):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
