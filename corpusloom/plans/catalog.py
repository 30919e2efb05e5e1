"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import code_queries, context_queries, evaluation_queries, graph_queries, index_queries, more_queries, text_queries

FLAGSHIP = "bm25f_topk"
_PARTS = (text_queries, graph_queries, context_queries, more_queries, code_queries, evaluation_queries, index_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
