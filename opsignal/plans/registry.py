"""Registry of named queries: a Spark plan and, where SQL can say it, the DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsignal.sources.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in PLANS.items()}
