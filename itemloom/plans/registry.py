"""Query registry: a Spark callable and, where SQL can say it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from itemloom.plans.bindings import Bank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(bank) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Bank], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Bank(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
