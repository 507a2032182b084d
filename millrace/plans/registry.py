"""Named queries with their checking SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.fixtures import Bank
from millrace.plans.oracles import sql as with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: dict[str, str] | None = None):
    """Register a function of the bank tables as query ``name``."""

    def register(build: Callable[[Bank], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Bank(spark, folder))
        if sql is not None:
            ORACLES[name] = with_tables(sql, tables)
        return build

    return register
