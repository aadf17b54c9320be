"""Registered queries: each applies operators to whole tables under the names the driver uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrasieve.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
