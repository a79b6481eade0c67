"""Lazy access to a directory of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsignal.session import use_utc


class Tables:
    """`Tables(spark, folder).events` reads `folder/events.parquet`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        use_utc(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
