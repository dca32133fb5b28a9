"""Registry of the queries exposed to the driver, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def query(name: str, sql: str | None = None, ops: tuple[str, ...] = ()) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, folder)`` under ``name`` with its comparison SQL."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        OPERATORS[name] = ops
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
