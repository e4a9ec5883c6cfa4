"""All registered queries of the engine, by name, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, knowledge_queries, lifecycle_queries, mutation_queries, scalar_queries, search_queries, stream_queries

FLAGSHIP = "recall_vector"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (search_queries, scalar_queries, lifecycle_queries, graph_queries, knowledge_queries, mutation_queries, stream_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
