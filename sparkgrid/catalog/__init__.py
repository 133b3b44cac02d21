"""Every operator as a named query over the test tables, with its SQL check."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ["sources", "scalars", "relations", "statistics", "windows", "kernels", "restoration", "spectra", "streams"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` and, when SQL can state it, its check."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"sparkgrid.catalog.{m}")
