"""All queries of the engine's own operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "theme_ranking"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir), and the SQL that has the same result."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


for _module in ("theme_queries", "document_queries", "graph_queries", "market_queries", "claim_queries", "vector_queries", "source_queries", "stream_queries", "rollup_queries", "linking_queries", "post_queries", "payload_queries", "catalyst_queries", "listing_queries", "entity_queries", "density_queries", "search_queries", "told_queries"):
    import_module(f"lodestream.plans.{_module}")
