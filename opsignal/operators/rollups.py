"""Grouped statistics over patterns, incidents and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsignal.functions.timecells import seconds_between
from opsignal.operators.joins import exists_between


def pattern_rollup(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Total count and first / last time per pattern, with the template as text."""
    template = F.array_join("tokens", " ").alias("template")
    return patterns.groupBy(*keys, "pattern_id", template).agg(
        F.sum("samples_count").alias("total_count"), F.min("first_seen").alias("first_seen"), F.max("first_seen").alias("last_seen")
    )


def pattern_baseline(patterns: DataFrame, keys: list[str], bucket: str, before) -> DataFrame:
    """Mean count per pattern over the buckets before a given one."""
    return patterns.filter(F.col(bucket) < before).groupBy(*keys).agg(F.avg("samples_count").alias("avg_count"))


def share_of_total(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row count and share per key. The total is taken over the grouped (small) result."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / df.agg(F.count("*")).scalar(), 6))


def prior_resolutions(incidents: DataFrame, rules: str) -> DataFrame:
    """How often incidents with a rule have been resolved before, for all rules at once."""
    solved = incidents.filter(F.col("status") == "resolved")
    return solved.select(F.explode(F.array_distinct(rules)).alias("rule_name")).groupBy("rule_name").agg(
        F.count("*").alias("times_resolved")
    )


def time_to_restore(incidents: DataFrame, keys: list[str]) -> DataFrame:
    """Mean seconds from opening to closing of resolved incidents."""
    solved = incidents.filter(F.col("status") == "resolved")
    return solved.groupBy(*keys).agg(
        F.round(F.avg(seconds_between("opened_at", "closed_at")), 3).alias("restore_s"), F.count("*").alias("n")
    )


def false_positive_rate(incidents: DataFrame, keys: list[str], no_action: Column) -> DataFrame:
    """Share of incidents on the known route that closed without any action."""
    known = incidents.filter(F.col("route") == "known")
    return known.groupBy(*keys).agg(F.round(F.count_if(no_action) / F.count("*"), 6).alias("false_positive_rate"))


def availability(heartbeats: DataFrame, ts: str, start, end, window: str = "5 minutes") -> DataFrame:
    """Share of windows between start and end that hold a heartbeat."""
    inside = heartbeats.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))
    seen = inside.select(F.window(ts, window)["start"].alias("w")).distinct().agg(F.count("*").alias("seen"))
    total = (end - start).total_seconds() / {"5 minutes": 300, "1 hour": 3600, "1 day": 86400}[window]
    return seen.select("seen", F.round(F.col("seen") / F.lit(total), 6).alias("availability"))


def change_failure_rate(
    deploys: DataFrame, incidents: DataFrame, keys: list[str], t_deploy: str, t_incident: str, within_s: float
) -> DataFrame:
    """Deploys per key and week, and the share followed by an incident within the given time."""
    followed = exists_between(deploys, incidents, keys, t_deploy, t_incident, 0, within_s, "_failed")
    week = F.date_trunc("week", t_deploy).cast("timestamp_ntz").alias("week")
    return followed.groupBy(*keys, week).agg(
        F.count("*").alias("deploys"), F.round(F.count_if("_failed") / F.count("*"), 6).alias("failure_rate")
    )


def delay_percentiles(df: DataFrame, keys: list[str], start: str, end: str, ps: list[float]) -> DataFrame:
    """Exact percentiles of whole-second delays.

    Delays are counted per second first, so the percentile works on distinct seconds with weights
    instead of holding every row of a group.
    """
    delay = F.floor(seconds_between(start, end)).cast("bigint").alias("delay_s")
    counted = df.groupBy(*keys, delay).agg(F.count("*").alias("n"))
    cols = [F.percentile("delay_s", F.lit(p), F.col("n")).alias(f"p{round(p * 100)}") for p in ps]
    return counted.groupBy(*keys).agg(*cols)


def rollup(df: DataFrame, keys: list[str], ts: str, value: str, width: str) -> DataFrame:
    """Sum, count, min and max per window: everything a coarser rollup needs."""
    w = F.window(ts, width)["start"].alias("bucket")
    return df.groupBy(*keys, w).agg(
        F.sum(value).alias("sum_value"), F.count(value).alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value")
    )


def re_rollup(fine: DataFrame, keys: list[str], width: str) -> DataFrame:
    """Coarser rollup from a finer one."""
    w = F.window("bucket", width)["start"].alias("coarse")
    return (
        fine.groupBy(*keys, w)
        .agg(
            F.sum("sum_value").alias("sum_value"), F.sum("n").alias("n"),
            F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        )
        .withColumnRenamed("coarse", "bucket")
    )
