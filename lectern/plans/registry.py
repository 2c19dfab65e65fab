"""Registry of named queries over the driver tables.

Each query is a function ``(spark, sf_dir) -> DataFrame``.  Queries that have a
DuckDB formulation register it as ``sql``; the driver runs both and compares.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` (and its oracle SQL when given)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that they register themselves."""
    from lectern.plans import (  # noqa: F401
        q_search, q_text, q_profile, q_ingest, q_vectors, q_misc, q_stream)
