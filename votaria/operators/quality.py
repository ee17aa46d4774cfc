"""Data-quality constraints, each one row: name, number of violations, verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows(name: str, df: DataFrame, bad: Column) -> DataFrame:
    """Rows for which ``bad`` holds."""
    return df.agg(F.count_if(bad).alias("n_bad")).select(F.lit(name).alias("name"), "n_bad")


def counts(df: DataFrame, bad: Mapping[str, Column]) -> DataFrame:
    """Several constraints on one table in one pass: rows for which each holds."""
    one = df.agg(*[F.count_if(c).alias(name) for name, c in bad.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"`{name}`").alias("n_bad")) for name in bad])))


def missing(name: str, df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in ``other``."""
    return df.join(other.select(*key).distinct(), key, "left_anti").agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("name"), "n_bad")


def repeated(name: str, df: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*key).agg((F.count("*") - 1).alias("_more")).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("n_bad")).select(F.lit(name).alias("name"), "n_bad")


def report(checks: Sequence[DataFrame]) -> DataFrame:
    """All constraints in one frame."""
    return reduce(DataFrame.unionByName, checks).withColumn("ok", F.col("n_bad") == 0)
