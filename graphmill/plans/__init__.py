"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphmill.plans import audit, code, connectors, data_quality, history, knowledge, resolution, retail, rewriting, sanitizing, segmentation, summaries, texts

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (audit, code, connectors, data_quality, history, knowledge, resolution, retail, rewriting, sanitizing, segmentation, summaries, texts)


def queries() -> dict[str, Query]:
    """All queries of the core."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that SQL can express."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
