"""Table loading for the Parquet layout ``<dir>/<table>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table; a file or a folder of part files both work."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
