"""Metric correlation and leading indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.timecells import SECOND, cell, epoch_us, from_epoch_us
from opsignal.operators.joins import exists_between, interval_join


def lagged_pearson(
    samples: DataFrame, keys: list[str], metric: str, ts: str, value: str, step_s: int, window_s: int, max_lag: int = 10,
    min_r: float = fv.CORRELATION_MIN_R,
) -> DataFrame:
    """Strongest lagged correlation of each metric pair of a key and window.

    Samples are averaged on a grid. For a positive lag L, a[i + L] is paired with b[i] (b leads). The
    pairs come from an equi join on (key, window, grid index); a window has window/step indices and a
    key a fixed set of metrics, so nothing grows with the raw volume after the grid. Ties go to the
    smaller |lag|, then the smaller lag.
    """
    grid = samples.groupBy(*keys, F.col(metric).alias("metric"), cell(ts, step_s).alias("_cell")).agg(F.avg(value).alias("v"))
    per = window_s // step_s
    grid = grid.withColumn("win", F.floor(F.col("_cell") / per)).withColumn("i", F.pmod("_cell", F.lit(per)))
    on = [*keys, "win", "i"]
    lags = F.sequence(F.lit(-max_lag), F.lit(max_lag))
    a = grid.select(*keys, "win", F.col("metric").alias("a"), F.col("v").alias("x"), F.col("i").alias("_ia"), F.explode(lags).alias("lag"))
    a = a.withColumn("i", F.col("_ia") - F.col("lag")).filter(F.col("i").between(0, per - 1)).drop("_ia")
    b = grid.select(*keys, "win", F.col("metric").alias("b"), F.col("v").alias("y"), "i")
    pairs = a.join(b, on).filter(F.col("a") < F.col("b"))
    stats = pairs.groupBy(*keys, "win", "a", "b", "lag").agg(
        F.count("*").alias("n"), F.covar_pop("x", "y").alias("cov"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")
    )
    usable = (F.col("n") >= fv.CORRELATION_MIN_POINTS) & (F.col("sx") >= fv.CORRELATION_MIN_STD) & (F.col("sy") >= fv.CORRELATION_MIN_STD)
    # 12 digits: exact ties must tie in floating point too
    rank = F.struct(F.round(F.abs("r"), 12), -F.abs("lag"), -F.col("lag"))
    moving = stats.filter(usable).withColumn("r", F.col("cov") / (F.col("sx") * F.col("sy")))
    best = moving.groupBy(*keys, "win", "a", "b").agg(F.max_by(F.struct("lag", "r"), rank).alias("best"))
    return best.filter(F.abs("best.r") >= min_r).select(
        *keys, F.timestamp_micros(F.col("win") * window_s * SECOND).cast("timestamp_ntz").alias("window_start"),
        "a", "b", (F.col("best.lag") * step_s).cast("int").alias("lag_s"), F.round("best.r", 4).alias("r"),
    )


def lead_up_features(
    incidents: DataFrame, samples: DataFrame, keys: list[str], opened: str, ts: str, lookahead_s: int, gap_s: int, step_s: int
) -> DataFrame:
    """Slope and peak |z| of each metric before each incident, samples in [t - lookahead, t - gap].

    incidents(incident_id, incident_type, keys, opened), samples(keys, metric, ts, value). Samples are
    averaged on a grid first, so a window has at most lookahead/step points per metric. Incidents of a key
    that see the same points share a window: its moments are taken once, so the pairs of windows and points
    follow the time that the incidents span, not their number. Rows that repeat an incident (id, type and
    keys) count as one, with the points of all their windows.
    """
    step, lo, hi = step_s * SECOND, int(-lookahead_s * SECOND), int((-gap_s + 1e-6) * SECOND)
    up = lambda us: ((us + F.pmod(-us, F.lit(step))) / F.lit(step)).cast("bigint")
    ends = {"_from": up(epoch_us(opened) + lo), "_to": up(epoch_us(opened) + hi) - 1}
    seen = incidents.withColumns(ends).filter(F.col("_from") <= F.col("_to"))
    grid = samples.groupBy(*keys, "metric", cell(ts, step_s).alias("_c")).agg(F.avg("value").alias("value"))
    window = [*keys, "_from", "_to"]
    spans = seen.select(*window).distinct().withColumn("_start", from_epoch_us(F.col("_from") * step))
    points = interval_join(spans, grid.withColumn("at", from_epoch_us(F.col("_c") * step)), keys, "_start", "at", 0, max(hi - lo, step) / SECOND)
    x = (F.col("_c") - F.col("_from")).cast("double") * F.lit(float(step_s))
    y = F.col("value")
    moments = points.filter(F.col("_c") <= F.col("_to")).groupBy(*window, "metric").agg(
        F.count("*").alias("n"), F.regr_count(y, x).alias("_m"), F.regr_avgx(y, x).alias("_x"), F.avg(y).alias("_y"), F.max(y).alias("_hi"),
        F.min(y).alias("_lo"), F.regr_sxx(y, x).alias("_xx"), F.regr_sxy(y, x).alias("_xy"), F.regr_syy(y, x).alias("_yy"),
    )
    rows = seen.join(moments, window).withColumn("_x", F.col("_x") + (F.col("_from") * step - epoch_us(opened)) / F.lit(float(SECOND)))
    total = lambda c: F.sum(F.col("_m") * c)
    still = lambda c: F.max(c) == F.min(c)
    # moments of one window, plus those of the windows' means where a repeated incident has several
    between = lambda a, b: F.when(still(a) | still(b), F.lit(0.0)).otherwise(
        total(F.col(a) * F.col(b)) - F.try_divide(total(F.col(a)) * total(F.col(b)), F.sum("_m"))
    )
    per = rows.groupBy("incident_id", "incident_type", *keys, "metric").agg(
        F.sum("n").alias("n"), F.sum("_m").alias("_m"), F.try_divide(total(F.col("_y")), F.sum("_m")).alias("_mean"),
        F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"), (F.sum("_xx") + between("_x", "_x")).alias("_xx"),
        (F.sum("_xy") + between("_x", "_y")).alias("_xy"), (F.sum("_yy") + between("_y", "_y")).alias("_yy"),
    )
    far = F.greatest(F.col("_hi") - F.col("_mean"), F.col("_mean") - F.col("_lo"))
    sd = F.sqrt(F.greatest(F.try_divide(F.col("_yy"), F.col("_m") - 1), F.lit(0.0)))
    slope = F.coalesce(F.try_divide(F.col("_xy"), F.col("_xx")), F.lit(0.0))
    # spread below rounding noise counts as constant
    peak = F.when(F.col("_m") > 1, F.when(sd > 1e-9, far / F.when(sd > 1e-9, sd)))
    return per.filter(F.col("n") >= 3).select("incident_id", "incident_type", *keys, "metric", "n", slope.alias("slope"), peak.alias("peak_z"))


def leading_indicators(features: DataFrame, keys: list[str], min_incidents: int = 3) -> DataFrame:
    """Thresholds per (type, key, metric): mean slope and mean peak z over enough incidents."""
    g = features.groupBy("incident_type", *keys, "metric").agg(
        F.count("*").alias("sample_count"), F.avg("slope").alias("_s"), F.coalesce(F.avg("peak_z"), F.lit(0.0)).alias("_z")
    )
    telling = ~((F.abs("_s") < 1e-9) & (F.col("_z") < 1.5))
    return g.filter((F.col("sample_count") >= min_incidents) & telling).select(
        "incident_type", *keys, "metric", F.round("_s", 6).alias("slope_threshold"), F.round("_z", 3).alias("zscore_threshold"), "sample_count"
    )


def indicator_fire(live: DataFrame, indicators: DataFrame, keys: list[str], min_samples: int = 10) -> DataFrame:
    """Live features (keys, metric, at, slope, peak_z) that exceed a trained threshold.

    The slope must exceed the threshold in the direction the indicator was trained on.
    """
    trained = indicators.filter(F.col("sample_count") >= min_samples)
    both = live.join(trained, [*keys, "metric"])
    steeper = F.when(F.col("slope_threshold") > 0, F.col("slope") > F.col("slope_threshold")).otherwise(
        (F.col("slope_threshold") < 0) & (F.col("slope") < F.col("slope_threshold"))
    )
    return both.filter(steeper | (F.col("peak_z") > F.col("zscore_threshold")))


def confirm_predictions(fired: DataFrame, incidents: DataFrame, keys: list[str], at: str, opened: str, within_s: float) -> DataFrame:
    """Mark each prediction by whether an incident of its key opened within the look-ahead."""
    # after the prediction, so the range starts one microsecond later
    return exists_between(fired, incidents, keys, at, opened, 1 / SECOND, within_s, "confirmed")


PAIR = ["a", "b", "lag_s"]


def merge_hits(stored: DataFrame | None, batch: DataFrame, keys: list[str], incident: str, ts: str) -> DataFrame:
    """Hits of metric pairs, one per (keys, a, b, lag_s, incident), the latest by ts: stored ones and those of a batch.

    A batch that is merged again, whole or in part, changes nothing. Rows: keys, a, b, lag_s, r, incident, ts.
    """
    columns = [*keys, *PAIR, incident, ts, "r"]
    rows = batch.select(*columns) if stored is None else stored.select(*columns).unionByName(batch.select(*columns))
    return rows.groupBy(*keys, *PAIR, incident).agg(F.max(F.struct(ts, "r")).alias("_m")).select(*keys, *PAIR, incident, f"_m.{ts}", "_m.r")


def best_pairs(pairs: DataFrame, keys: list[str], ts: str | None = None) -> DataFrame:
    """Accumulated metric pairs: hits and mean |r| per (keys, a, b, lag); with ts also the latest r and when it was seen."""
    more = [F.max_by("r", F.struct(ts, "r")).alias("latest_r"), F.max(ts).alias("last_seen")] if ts else []
    return pairs.groupBy(*keys, *PAIR).agg(F.count("*").alias("incident_count"), F.avg(F.abs("r")).alias("avg_r"), *more)
