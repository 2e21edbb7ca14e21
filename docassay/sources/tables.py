"""Parquet table source: declared reads, redelivery-safe keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *key: str) -> DataFrame:
    """Redelivered rows repeat a key with equal content: keep one row of each key."""
    return df.dropDuplicates(list(key))


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Register tables as temporary views for SQL plans."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
