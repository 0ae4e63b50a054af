"""Registry of the engine's queries: each name maps to a DataFrame builder and, where SQL can express it, to DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: Modules whose import registers their queries.
MODULES = (
    "plans.retrieval", "plans.ranking", "plans.ontology", "plans.setmetrics", "plans.texts", "plans.assertions", "plans.context", "plans.sources", "plans.phases", "plans.privacy",
    "plans.extraction", "plans.phrases", "plans.fidelity", "plans.exports", "plans.service", "plans.mapping", "plans.chunking", "plans.details", "plans.notes",
    "streaming.usage",
)


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator that puts a query, and its SQL if any, into the registry."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return put


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"termloom.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
