"""Where queries and the SQL that they equal are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function by its name, with SQL where there is some."""

        def add(function: Query) -> Query:
            name = function.__name__
            if name in self.queries:
                raise ValueError(f"{name} is registered already")
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return add


CATALOGUE = Catalogue()
query = CATALOGUE.query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
