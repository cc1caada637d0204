"""The queries of the training-data subpackage against SQL, and on empty tables."""

from __future__ import annotations

import pytest
from conftest import DATA, TABLES

from papyra.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(name, spark, empty_tables):
    rows = registry.queries()[name](spark, empty_tables).collect()
    # only the contract's own conversation is left
    assert len(rows) == (1 if name == "op4_chat_format" else 0)
