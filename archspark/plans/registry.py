"""All queries of the core, collected from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archspark.plans import audit_queries, code_queries, graph_queries, hierarchy_queries, source_queries

MODULES = (graph_queries, audit_queries, code_queries, source_queries, hierarchy_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
