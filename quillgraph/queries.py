"""Registered queries of the engine, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `oracle` names views in braces."""

    def register(f: Query) -> Query:
        from quillgraph.views import sql

        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle.strip())
        return f

    return register


def _load() -> None:
    from quillgraph.plans import catalog_queries, change_queries, graph_queries, library_queries, read_queries, search_queries, text_queries  # noqa: F401


_load()
