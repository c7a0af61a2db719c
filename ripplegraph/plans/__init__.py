"""Registry of the graph and dynamics queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dynamics, graph, quality, reports, structure

PARTS = (graph, structure, dynamics, quality, reports)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.g26_w7_hubs(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
