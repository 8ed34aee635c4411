"""Every query of the engine by name, with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules that register queries.
MODULES = ["scalar_queries", "linkage_queries", "relation_queries", "knowledge_queries", "flow_queries", "store_queries"]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; without ``oracle`` only tests and row counts check it."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _loaded() -> None:
    for name in MODULES:
        importlib.import_module(f"ledgerline.plans.{name}")


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_ORACLES)
