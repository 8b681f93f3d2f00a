"""Readers of the parquet tables; every reader is lazy and lets Catalyst prune columns and push filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``directory``."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
