"""Anomaly detection on hourly baselines and indicator functions on gridded series.

Input is one row per (series, hour) or (series, step): at most span/step rows per series, so the
ordered windows below are bounded by time and not by raw volume.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.timecells import DAY, HOUR, SECOND, epoch_us
from opsignal.operators.ranges import regular_grid


def hourly_baseline(df: DataFrame, keys: list[str], ts: str, value: Column) -> DataFrame:
    """Value per series and hour with its weekday (Monday = 0) and hour of day."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_bucket")
    return df.groupBy(*keys, hour).agg(value.alias("value")).withColumns(
        {"day_of_week": F.weekday("hour_bucket"), "hour_of_day": F.hour("hour_bucket")}
    )


def _seconds(t: str) -> Column:
    return F.floor(epoch_us(t) / SECOND).cast("bigint")


def _trailing_days(keys: list[str], days: int, last_s: int = 0):
    return Window.partitionBy(*keys).orderBy(_seconds("hour_bucket")).rangeBetween(-days * DAY, last_s)


def seasonal_ratio(
    base: DataFrame, keys: list[str], days: int = fv.HISTORY_DAYS, threshold: float = fv.RATIO_THRESHOLD, min_points: int = 1
) -> DataFrame:
    """Value against the mean of the same weekday and hour in the trailing days.

    A zero mean fires only above a floor value.
    """
    w = Window.partitionBy(*keys, "day_of_week", "hour_of_day").orderBy(_seconds("hour_bucket")).rangeBetween(-days * DAY, -1)
    rows = base.withColumns({"baseline_avg": F.avg("value").over(w), "_n": F.count("value").over(w)})
    rows = rows.filter(F.col("_n") >= min_points).drop("_n")
    ratio = F.when(
        F.col("baseline_avg") == 0, F.when(F.col("value") > fv.ZERO_BASELINE_MIN, F.lit(float("inf"))).otherwise(0.0)
    ).otherwise(F.col("value") / F.when(F.col("baseline_avg") != 0, F.col("baseline_avg")))
    return rows.withColumn("ratio", ratio).withColumn("is_anomaly", F.col("ratio") >= threshold)


def iqr_anomaly(
    base: DataFrame, keys: list[str], c: float = fv.IQR_FACTOR, days: int = fv.HISTORY_DAYS, min_points: int = fv.MIN_BASELINE_POINTS
) -> DataFrame:
    """Hours outside the quartile fences of the trailing days, the current hour included."""
    w = _trailing_days(keys, days)
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(w)
    rows = base.withColumn("_q", q).withColumn("_n", F.count("value").over(w) - 1)
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    outside = (F.col("value") < q1 - c * (q3 - q1)) | (F.col("value") > q3 + c * (q3 - q1))
    return rows.filter((F.col("_n") >= min_points) & outside).withColumns({"q1": q1, "q3": q3}).drop("_q", "_n")


def _flag_large(rows: DataFrame, keys: list[str], c: float, days: int, min_points: int) -> DataFrame:
    w = _trailing_days(keys, days)
    q = F.percentile("diff", F.array(F.lit(0.25), F.lit(0.75))).over(w)
    rows = rows.filter(F.col("diff").isNotNull()).withColumn("_q", q).withColumn("_n", F.count("diff").over(w) - 1)
    fence = F.col("_q")[1] + c * (F.col("_q")[1] - F.col("_q")[0])
    return rows.filter((F.col("_n") >= min_points) & (F.col("diff") > fence) & F.col("value").isNotNull()).withColumn("fence", fence).drop("_q", "_n")


def level_shift(
    base: DataFrame, keys: list[str], n: int = 24, c: float = fv.LEVEL_SHIFT_FACTOR, days: int = fv.HISTORY_DAYS,
    min_points: int = fv.MIN_BASELINE_POINTS, least: int | None = None,
) -> DataFrame:
    """Upward shift: median of the last n hours over that of the n before, far outside usual differences.

    The hours between a series' first and last stand on a regular grid, those without a value as nulls; a window with fewer than
    `least` values (all n by default) gives no difference, and an hour without a value isn't flagged.
    """
    o = Window.partitionBy(*keys).orderBy("hour_bucket")
    now, before = o.rowsBetween(-(n - 1), 0), o.rowsBetween(-(2 * n - 1), -n)
    enough = (F.count("value").over(now) >= (least or n)) & (F.count("value").over(before) >= (least or n))
    diff = F.when(enough, F.percentile("value", F.lit(0.5)).over(now) - F.percentile("value", F.lit(0.5)).over(before))
    return _flag_large(regular_grid(base, keys, "hour_bucket", HOUR, ["value"]).withColumn("diff", diff), keys, c, days, min_points)


def persist_anomaly(
    base: DataFrame, keys: list[str], n: int = 1, c: float = fv.PERSIST_FACTOR, days: int = fv.HISTORY_DAYS,
    min_points: int = fv.MIN_BASELINE_POINTS, least: int | None = None,
) -> DataFrame:
    """Value far above the median of the n hours before it; grid, nulls and least as in level_shift()."""
    before = Window.partitionBy(*keys).orderBy("hour_bucket").rowsBetween(-n, -1)
    diff = F.when(F.count("value").over(before) >= (least or n), F.col("value") - F.percentile("value", F.lit(0.5)).over(before))
    return _flag_large(regular_grid(base, keys, "hour_bucket", HOUR, ["value"]).withColumn("diff", diff), keys, c, days, min_points)


def deviation_ratio(base: DataFrame, keys: list[str]) -> DataFrame:
    """Value over the mean of all earlier points; infinite when that mean is not positive."""
    w = Window.partitionBy(*keys).orderBy("hour_bucket").rowsBetween(Window.unboundedPreceding, -1)
    avg = F.coalesce(F.avg("value").over(w), F.lit(0.0))
    rows = base.withColumn("baseline_avg", avg)
    ratio = F.when(F.col("baseline_avg") > 0, F.col("value") / F.when(F.col("baseline_avg") > 0, F.col("baseline_avg")))
    return rows.withColumn("ratio", F.coalesce(ratio, F.lit(float("inf"))))


def rolling_zscore(base: DataFrame, keys: list[str], short_days: int = 7, long_days: int = 28, limit: float = 2.0, runs: int = 3) -> DataFrame:
    """Rolling means, z against the short window, and whether z stayed above the limit for more than `runs` windows."""
    short, long = _trailing_days(keys, short_days), _trailing_days(keys, long_days)
    std = F.stddev_samp("value").over(short)
    rows = base.withColumns({"mean_short": F.avg("value").over(short), "_std": std, "mean_long": F.avg("value").over(long)})
    z = F.when(F.col("_std") > 0, (F.col("value") - F.col("mean_short")) / F.when(F.col("_std") > 0, F.col("_std")))
    rows = rows.withColumn("zscore", z)
    last = Window.partitionBy(*keys).orderBy("hour_bucket").rowsBetween(-runs, 0)
    above = F.sum(F.when(F.col("zscore") > limit, 1).otherwise(0)).over(last)
    return rows.withColumn("sustained", above == runs + 1).drop("_std")


def seasonal_residual(base: DataFrame, keys: list[str], slot: str = "hour_of_day", limit: float = 3.0) -> DataFrame:
    """Residual after removing the mean of the daily slot, and its z over the series."""
    rows = base.withColumn("resid", F.col("value") - F.avg("value").over(Window.partitionBy(*keys, slot)))
    whole = Window.partitionBy(*keys)
    std = F.stddev_samp("resid").over(whole)
    rows = rows.withColumn("_mean", F.avg("resid").over(whole)).withColumn("_std", std)
    z = F.when(F.col("_std") > 0, (F.col("resid") - F.col("_mean")) / F.when(F.col("_std") > 0, F.col("_std")))
    return rows.withColumn("zscore", z).filter(F.col("zscore") > limit).drop("_mean", "_std")


def bollinger(base: DataFrame, keys: list[str], n: int = 20, k: float = 2.0) -> DataFrame:
    """Mean and +-k standard deviations (population) of the last n points; breach when above the upper band."""
    w = Window.partitionBy(*keys).orderBy("hour_bucket").rowsBetween(-(n - 1), 0)
    rows = base.withColumns({"mid": F.avg("value").over(w), "_sd": F.stddev_pop("value").over(w), "_n": F.count("value").over(w)})
    rows = rows.filter(F.col("_n") == n).withColumns({"upper": F.col("mid") + k * F.col("_sd"), "lower": F.col("mid") - k * F.col("_sd")})
    return rows.withColumn("breach", F.col("value") > F.col("upper")).drop("_sd", "_n")


def rsi(base: DataFrame, keys: list[str], n: int = 14) -> DataFrame:
    """Relative strength with plain averages of the last n gains and losses."""
    o = Window.partitionBy(*keys).orderBy("hour_bucket")
    rows = base.withColumn("_d", F.col("value") - F.lag("value").over(o)).filter(F.col("_d").isNotNull())
    w = o.rowsBetween(-(n - 1), 0)
    gain, loss = F.sum(F.greatest("_d", F.lit(0.0))).over(w), F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(w)
    rows = rows.withColumns({"_g": gain, "_l": loss, "_n": F.count("_d").over(w)}).filter(F.col("_n") == n)
    both = F.col("_g") + F.col("_l")
    return rows.withColumn("rsi", F.when(both > 0, 100 * F.col("_g") / F.when(both > 0, both)).otherwise(50.0)).drop("_d", "_g", "_l", "_n")


def _smoothed(x: np.ndarray, span: int) -> np.ndarray:
    """Exponential mean: each value moves the level by 2 / (span + 1) of the way to itself; the first one is the first level."""
    out, share = np.empty(len(x)), 2.0 / (span + 1)
    for i, y in enumerate(x):
        level = y if i == 0 else level + share * (y - level)
        out[i] = level
    return out


def macd(base: DataFrame, keys: list[str], fast: int = 6, slow: int = 13, signal: int = 5) -> DataFrame:
    """MACD of the hourly differences and its upward crossings, from the second hour of each series on.

    Exponential means are recursive, so a series, one row an hour, is one group.
    """
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name in keys)
    schema = f"{key_schema}, hour_bucket timestamp_ntz, macd double, macd_signal double, crossed boolean"

    def per_series(pdf):
        pdf = pdf.sort_values("hour_bucket")
        steps = np.diff(pdf["value"].to_numpy())
        line = _smoothed(steps, fast) - _smoothed(steps, slow)
        mean = _smoothed(line, signal)
        above = line > mean
        crossed = above.copy()
        crossed[1:] &= ~above[:-1]
        crossed[:1] = False
        return pdf.iloc[1:][[*keys, "hour_bucket"]].assign(macd=line, macd_signal=mean, crossed=crossed)

    return base.select(*keys, "hour_bucket", "value").groupBy(*keys).applyInPandas(per_series, schema)


def hurst(base: DataFrame, keys: list[str], points: int = 100, sizes: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """Rescaled-range exponent of the last points of each series: slope of log(R/S) on log(size).

    Every block of every size is cut, cumulated and ranged with windows; blocks hold at most
    `points` rows.
    """
    o = Window.partitionBy(*keys).orderBy(F.col("hour_bucket").desc())
    last = base.withColumn("_i", F.row_number().over(o) - 1).filter(F.col("_i") < points).withColumn("_i", points - 1 - F.col("_i"))
    full = Window.partitionBy(*keys)
    last = last.withColumn("_n", F.count("*").over(full)).filter(F.col("_n") == points)
    blocks = last.select(*keys, "_i", "value", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("_size"))
    blocks = blocks.withColumn("_block", F.floor(F.col("_i") / F.col("_size")))
    b = Window.partitionBy(*keys, "_size", "_block")
    dev = blocks.withColumn("_dev", F.col("value") - F.avg("value").over(b)).withColumn("_sd", F.stddev_pop("value").over(b))
    run = dev.withColumn("_cum", F.sum("_dev").over(b.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    rs = run.groupBy(*keys, "_size", "_block").agg((F.max("_cum") - F.min("_cum")).alias("_r"), F.max("_sd").alias("_s"))
    per_size = rs.filter(F.col("_s") > 0).groupBy(*keys, "_size").agg(F.avg(F.col("_r") / F.col("_s")).alias("_rs"))
    fit = F.regr_slope(F.log("_rs"), F.log("_size"))
    return per_size.filter(F.col("_rs") > 0).groupBy(*keys).agg(fit.alias("hurst")).withColumn("is_trending", F.col("hurst") > 0.6)


