"""The registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio.plans import correlation_queries, event_queries, inventory_queries, metric_queries, source_queries

MODULES = (inventory_queries, correlation_queries, metric_queries, source_queries, event_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory_queries.scored(spark, sf_dir)
    return rows.groupBy("scan_id", "system", "band").agg(
        F.count(F.lit(1)).alias("components"), F.max("score").alias("max_score")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}
