"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexassay.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, columns pruned and filters pushed by the plan that uses it."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
