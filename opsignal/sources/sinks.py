"""Append, latest-wins and retention sinks on partitioned parquet."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def append_monthly(df: DataFrame, path: str, ts: str, sort: list[str]) -> None:
    """Append rows under month=YYYY-MM, sorted inside each file so row groups can be skipped.

    Rows are clustered by day and a spread column first: few files per month, and no month or
    day lands in a single task.
    """
    _by_month(df, ts, sort).mode("append").partitionBy("month").parquet(path)


def _by_month(df: DataFrame, ts: str, sort: list[str]) -> DataFrameWriter:
    dealt = df.withColumn("month", F.date_format(ts, "yyyy-MM")).repartition(F.to_date(ts), F.pmod(F.xxhash64(*sort), F.lit(32)))
    return dealt.sortWithinPartitions("month", *sort).write


def read_months(spark: SparkSession, path: str, schema: str, start: dt.datetime, end: dt.datetime, ts: str) -> DataFrame:
    """Rows in [start, end) reading only the month folders that can hold them. schema: of the rows, without month."""
    lo, hi = start.strftime("%Y-%m"), end.strftime("%Y-%m")
    df = spark.read.schema(f"{schema}, month string").parquet(path)
    return df.filter(F.col("month").between(lo, hi) & (F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def months_to_drop(months: list[str], as_of: dt.datetime, keep_days: int) -> list[str]:
    """Month partitions whose every row is older than the retention limit."""
    limit = as_of - dt.timedelta(days=keep_days)
    return [m for m in months if m < limit.strftime("%Y-%m")]


def stored_months(spark: SparkSession, path: str) -> list[str]:
    """Months that the table has folders of; no data is read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n.removeprefix("month=") for n in names if n.startswith("month="))


def expire_months(spark: SparkSession, path: str, as_of: dt.datetime, keep_days: int) -> list[str]:
    """Delete the month folders that are wholly older than the retention limit; gives the months deleted."""
    old = months_to_drop(stored_months(spark, path), as_of, keep_days)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for m in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"month={m}"), True)
    return old


def replace_months(df: DataFrame, path: str, ts: str, sort: list[str]) -> None:
    """Write the rows in place of all that the table has of their months; other months stay. A second time changes nothing."""
    _by_month(df, ts, sort).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def latest_months(df: DataFrame, path: str, schema: str, ts: str, keys: list[str], version: str, sort: list[str]) -> None:
    """Merge rows into the table: of the same keys in a month the row with the greatest version stays, in both old and new rows.

    Only the months that the new rows have are read and written. A batch that is given again changes nothing.
    """
    spark = df.sparkSession
    months = [r["m"] for r in df.select(F.date_format(ts, "yyyy-MM").alias("m")).distinct().collect()]
    columns = df.columns
    have = set(stored_months(spark, path)) & set(months)
    rows = df
    if have:
        old = spark.read.schema(f"{schema}, month string").parquet(path).filter(F.col("month").isin(sorted(have))).select(*columns)
        rows = df.unionByName(old)
    month = F.date_format(ts, "yyyy-MM")
    best = rows.groupBy(*keys, month.alias("_m")).agg(F.max_by(F.struct(*columns), F.struct(version, F.xxhash64(*columns))).alias("_r")).select("_r.*")
    # the rows are read from the folders that are written: they must be complete before the first is replaced
    if have:
        ready = f"{work_folder(spark)}"
        best.write.parquet(ready)
        best = spark.read.schema(best.schema).parquet(ready)
    replace_months(best, path, ts, sort)


def add_missing_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Additive schema evolution: columns an older table lacks, with their defaults."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def work_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach, in spark.checkpoint.dir or else the warehouse; it goes with the session."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/table-{uuid.uuid4().hex}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return at.toString()
