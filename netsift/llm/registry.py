"""Queries of this subpackage and their SQL counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES: list[str] = [
    "secret_scan",
    "decontamination",
    "url_filter",
    "vector_search",
    "chat_format",
    "quality",
    "toxicity",
    "packing",
    "near_duplicates",
    "language_model",
    "spelling",
    "prefix_trie",
    "simhash",
]


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` says the same to the checking engine."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"netsift.llm.{module}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
