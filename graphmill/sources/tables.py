"""Parquet tables of a dataset directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the dataset directory; column pruning and pushdown reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
