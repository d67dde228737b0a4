"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wiremill.plans import news_queries, pipeline_queries, stream_queries

_PARTS = (news_queries, pipeline_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.Q.items()}
ORACLES: dict[str, str] = {k: s for part in _PARTS for k, s in part.SQL.items()}
