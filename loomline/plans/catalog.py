"""The registered queries over the driver's tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.plans import activity_queries, graph_queries, history_queries, lookup_queries, nested_queries, session_queries, source_queries, text_queries, view_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _area in (graph_queries, history_queries, activity_queries, source_queries, lookup_queries, nested_queries, session_queries, text_queries, view_queries):
    QUERIES |= _area.QUERIES
    ORACLES |= _area.ORACLES
