"""Registered queries: one per operator, each with an independent SQL text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ["judgement", "aggregates", "scalars", "hint_rules", "joins", "windows", "curation", "store", "learning", "streams"]


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is its counterpart for the checking engine."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
