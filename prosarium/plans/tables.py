"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """Tables that lie in fewer pieces than there are cores are dealt out by key before costly expressions; larger ones
    are read as they lie, without a shuffle. df must be a plain scan or projection of one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
