"""Readers of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` under `folder`, one Parquet file or directory each."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as the session has cores, for work that costs
    far more than moving its rows. A scan that has them already isn't touched, so large
    inputs are never exchanged for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
