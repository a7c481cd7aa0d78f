"""Registering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add
