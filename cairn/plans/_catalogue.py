"""A catalogue of queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalogue:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function (table reader) -> DataFrame under its own name."""

        def register(build: Callable):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            run.__name__, run.__doc__ = build.__name__, build.__doc__
            self.QUERIES[build.__name__] = run
            if sql is not None:
                self.ORACLES[build.__name__] = sql
            return build

        return register
