"""Streamed forms of the counting, session and join operators. Every one takes a streaming or a batch frame.

Time is event time: a row more than `late` behind the newest one may be dropped, so results of a window are final. The
checkpoint location of a running query is always the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal.sources.payloads import split_logs


def timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """The rows with their instant as a timestamp with a watermark; ts may be without a zone (UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def distinct_events(df: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key; repeats that arrive within the watermark are dropped, also in later batches."""
    out = timed(df, ts, late)
    return out.dropDuplicatesWithinWatermark(key) if df.isStreaming else out.dropDuplicates(key)


def window_counts(df: DataFrame, keys: list[str], ts: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows per key in tumbling windows [start, end), or in sliding ones."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = timed(df, ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def incident_sessions(alerts: DataFrame, ns: str, rule: str, ts: str, gap_s: int, late: str) -> DataFrame:
    """Sessions of alerts that are less than gap_s apart, per namespace and rule.

    A session window would join rows exactly one gap apart, so its gap is a microsecond shorter.
    """
    gap = f"{gap_s * 1_000_000 - 1} microseconds"
    rows = timed(alerts, ts, late).select(F.col(ns).alias("ns"), F.coalesce(F.col(rule), F.lit("")).alias("rule"), ts)
    s = rows.groupBy("ns", "rule", F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_alerts"), F.min(ts).alias("opened_at"), F.max(ts).alias("window_end"))
    return s.select("ns", "rule", "opened_at", "window_end", "n_alerts")


def interval_join(triggers: DataFrame, signals: DataFrame, keys: list[str], trigger_ts: str, signal_ts: str, before: str, late: str) -> DataFrame:
    """Each trigger with the signals of its keys in [trigger - before, trigger); both sides' state is bounded by the watermark."""
    left, right = timed(triggers, trigger_ts, late).alias("l"), timed(signals, signal_ts, late).alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    near = F.expr(f"r.{signal_ts} >= l.{trigger_ts} - INTERVAL {before} AND r.{signal_ts} < l.{trigger_ts}")
    on = near
    for c in same:
        on = on & c
    others = [F.col(f"r.{c}") for c in signals.columns if c not in keys]
    return left.join(right, on).select("l.*", *others)


def append_batches(path: str):
    """foreachBatch writer of Parquet that may be given the same batch again: a batch replaces its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return write


def ingest_batches(path: str, line: str = "raw", conn_host: str = "conn_host"):
    """foreachBatch writer: normalised rows to path/logs, rows that can't be read to path/quarantine.

    Each batch is parsed once and replaces its own folders, so one that is given again after a failure counts once.
    """
    root = path.rstrip("/")

    def write(df: DataFrame, batch: int) -> None:
        kept = df.persist()
        try:
            good, bad = split_logs(kept, line, conn_host)
            good.write.mode("overwrite").parquet(f"{root}/logs/batch={batch}")
            bad.write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch}")
        finally:
            kept.unpersist()

    return write
