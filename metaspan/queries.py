"""Registry of the reference's operators: name -> DataFrame query, and name -> equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metaspan import queries_functions, queries_meta, queries_relational, queries_semantics, queries_sources, queries_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (queries_relational, queries_meta, queries_semantics, queries_sources, queries_sql, queries_functions):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
