"""Rows dealt out for work that is heavy for its bytes: adaptive execution would put small shuffles into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def deal(df: DataFrame, *by: str) -> DataFrame:
    """df by the hash of columns, in a number of partitions that is not lowered afterwards."""
    return df.repartition(tasks(df), *by)


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt out evenly where it comes in fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
