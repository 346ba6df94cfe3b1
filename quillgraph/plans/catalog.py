"""Every query of the engine by name, over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans import duplicate_queries, file_queries, graph_queries, retrieval_queries, web_queries

_ALL = retrieval_queries.QUERIES | duplicate_queries.QUERIES | graph_queries.QUERIES | web_queries.QUERIES | file_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
