"""Scans, latest-wins tables, retention, ranking and incremental reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsignal.functions.text import all_of
from opsignal.functions.timecells import as_col


def time_range_scan(df: DataFrame, ts: str, start, end, text: str | None = None) -> DataFrame:
    """Rows with start <= ts <= end; with `text`, only rows whose text is not empty."""
    out = df.filter(F.col(ts).between(start, end))
    return out.filter(F.col(text) != "") if text else out


def incremental_since(df: DataFrame, ts: str, cursor) -> DataFrame:
    """Rows newer than the cursor."""
    return df.filter(F.col(ts) > F.lit(cursor))


def initial_cursor(now: dt.datetime, lookback_s: int = 600) -> dt.datetime:
    return now - dt.timedelta(seconds=lookback_s)


def label_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def label_index(df: DataFrame, stream: str, labels: str) -> DataFrame:
    """Inverted index: one row per (stream, label key, label value)."""
    streams = df.select(stream, F.map_entries(labels).alias("_l")).distinct()  # few streams, many rows
    return streams.select(stream, F.explode("_l").alias("_e")).select(stream, F.col("_e.key").alias("label_key"), F.col("_e.value").alias("label_value")).distinct()


def streams_with(index: DataFrame, stream: str, wanted: dict[str, str]) -> DataFrame:
    """Streams that carry all the wanted labels: one pass over the index, not one scan per label."""
    conds = [(F.col("label_key") == k) & (F.col("label_value") == v) for k, v in wanted.items()]
    hit = F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conds)])
    return (
        index.filter(F.size(F.array_compact(hit)) > 0)
        .groupBy(stream)
        .agg(*[F.max(c).alias(f"_has{i}") for i, c in enumerate(conds)])
        .filter(all_of([F.col(f"_has{i}") for i in range(len(conds))]))
        .select(stream)
    )


def latest_by_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Newest row per key. An aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def fold_updates(states: DataFrame, keys: list[str], version: list[str], cols: list[str]) -> DataFrame:
    """Fold partial update rows (null = unchanged) into the current value of every column."""
    ver = F.struct(*version)
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ver)).alias(c) for c in cols]
    return states.groupBy(*keys).agg(*aggs)


def ttl_filter(df: DataFrame, written_at: str, as_of, ttl_days: Column | int | str) -> DataFrame:
    """Rows still alive at as_of; ttl_days is a number or a column."""
    days = F.lit(ttl_days) if isinstance(ttl_days, int) else as_col(ttl_days)
    expiry = F.col(written_at) + F.make_dt_interval(days.cast("int"))
    return df.filter(expiry > F.lit(as_of))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Global top-k; the order must end in a unique column."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, unique: str, spread: int = 16
) -> DataFrame:
    """First k rows of each group. Two rankings: inside (group, slice), then over the survivors.

    A group that holds a third of the table is ranked by `spread` tasks; the second ranking sees
    at most spread*k rows of it.
    """
    rank = F.row_number()
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(unique), F.lit(spread)))
    w1 = Window.partitionBy(*keys, "_slice").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    survivors = sliced.withColumn("_rn", rank.over(w1)).filter(F.col("_rn") <= k).drop("_slice", "_rn")
    return survivors.withColumn("rank", rank.over(w2)).filter(F.col("rank") <= k)


def search_text(df: DataFrame, text: str, needle: str, scope: Column | None = None) -> DataFrame:
    """Case-insensitive substring search with an optional scope filter."""
    hits = df.filter(F.col(text).ilike(f"%{needle}%"))
    return hits.filter(scope) if scope is not None else hits
