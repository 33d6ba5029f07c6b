"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from . import edits, gates, kept, memory, papers, retrieval, rules, tables, vaults, words

Query = Callable[[SparkSession, str], DataFrame]


def registered(*modules: ModuleType) -> tuple[dict[str, Query], dict[str, str]]:
    """The modules' queries and SQL; ValueError where a name is taken twice, isn't a function's, or has SQL alone."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in modules:
        if twice := set(queries) & set(module.QUERIES):
            raise ValueError(f"queries of the same name: {sorted(twice)}")
        if odd := [n for n, f in module.QUERIES.items() if not callable(f)] + sorted(set(module.SQL) - set(module.QUERIES)):
            raise ValueError(f"no query that can be called: {odd}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql


QUERIES, SQL = registered(retrieval, rules, memory, edits, papers, words, kept, vaults, gates, tables)
