"""Readers of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from votaria.session import ship_package


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of the data folder ``root``; columns are pruned by the plan that uses it."""
    ship_package(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")
