"""The registry of runnable queries with their SQL counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def shipped(fn: Query) -> Query:
    """The query, run in a session whose workers can import this package."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} exists")
            self.queries[name] = shipped(fn)
            if sql:
                self.sql[name] = sql
            return fn

        return keep
