"""All queries of the engine by name, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tessera.queries import base

MODULES = ["statistics", "texts", "retrieval", "citation", "ledgers", "stores", "streams", "reports", "records"]
for _name in MODULES:
    import_module(f"tessera.queries.{_name}")


def entry(spark: SparkSession) -> DataFrame:
    return base.QUERIES["knn_citation_weights"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return base.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.SQL
