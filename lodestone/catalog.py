"""Queries over the engine's operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.queries import base, conversions, evaluation, extraction, flows, graphs, indexes, models, retrieval, roundtrips, tables, tasks, texts

MODULES = (texts, retrieval, graphs, evaluation, extraction, tables, models, flows, tasks, conversions, indexes, roundtrips)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.build for name, q in base.REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in base.REGISTRY.items() if q.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.graph_to_ranked_chunks(spark, sf_dir)
