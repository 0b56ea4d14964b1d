"""Registration of queries beside the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[..., Callable[[Query], Query]]]:
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            key = name or f.__name__
            queries[key] = f
            if sql is not None:
                oracles[key] = sql
            return f

        return put

    return queries, oracles, query
