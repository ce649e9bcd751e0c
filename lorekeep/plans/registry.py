"""Registry of the library's queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Modules whose queries are registered on import.
MODULES = ("documents", "pages", "graph", "study", "media", "quality", "relational", "records", "chapters", "scanners")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a (spark, sf_dir) -> DataFrame function, with its SQL where SQL can express it."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Import every query module."""
    for module in MODULES:
        importlib.import_module(f"lorekeep.plans.{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return QUERIES["link_graph_dashboard"](spark, sf_dir)
