"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import construct_queries, episode_queries, maintenance_queries, memory_queries, page_queries, records, retrieval_queries, state_queries

MODULES = (records, memory_queries, retrieval_queries, maintenance_queries, episode_queries, construct_queries, page_queries, state_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.queries()["hierarchical_retrieval"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
