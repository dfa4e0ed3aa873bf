"""Queries by name, each paired with the DuckDB statement that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("bars", "series", "decisions", "simulation", "reports", "ledgers", "lookups", "streams", "scans")
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers the function under its name; without ``sql`` tests check it instead."""

    def keep(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql is not None:
            _oracles[name or f.__name__] = sql
        return f

    return keep


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"barcraft.plans.{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["timeframe_features"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
