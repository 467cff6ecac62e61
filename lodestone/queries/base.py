"""The registry of queries, and views of the test tables that several families use."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        if build.__name__ in REGISTRY:
            raise ValueError(f"two queries are named {build.__name__}")
        REGISTRY[build.__name__] = Query(build, sql)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
