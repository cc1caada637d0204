"""All registered queries of the library outside the training-data subpackage."""

from __future__ import annotations

import importlib

#: The modules that register queries.
MODULES = ("retrieval", "texts", "chunking", "graph", "logs", "modes", "details", "records", "vectors", "tools")

_QUERIES: dict = {}
_SQL: dict = {}


def register(name: str, sql: str | None = None):
    """Registers a callable (spark, sf_dir) -> DataFrame and, where SQL can express it, its check."""

    def keep(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def _load() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"papyra.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)
