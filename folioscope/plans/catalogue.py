"""All registered queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import channels, corpus, events, evidence, export, graphs, library, neighbours, pages, relational, search, structure

Query = Callable[[SparkSession, str], DataFrame]

MODULES: list[ModuleType] = [search, corpus, evidence, export, graphs, pages, events, relational, structure, library, neighbours, channels]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
