"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a folder; paths are opened by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same, its rows dealt out evenly: where a row costs far more work than bytes, a file is too few tasks."""
    return load(spark, sf_dir, name).repartition(4 * spark.sparkContext.defaultParallelism)
