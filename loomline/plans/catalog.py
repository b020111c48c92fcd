"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.plans import attempt_queries, conv_queries, incremental_queries, release_queries, retrieval_queries, slot_queries, stream_queries

MODULES = (incremental_queries, conv_queries, slot_queries, attempt_queries, retrieval_queries, stream_queries, release_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_queries.p1_found(spark, sf_dir)
