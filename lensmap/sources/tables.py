"""Parquet tables given to the engine (one file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of the driver-provided tables.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(table_path(sf_dir, name))
