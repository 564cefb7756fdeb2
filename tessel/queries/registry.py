"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """A folder's tables by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, oracle: str | None = None) -> Callable:
        """Register a function of the folder's tables, with the DuckDB SQL that must agree."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if oracle:
                self.oracle[name] = oracle
            return f

        return add
