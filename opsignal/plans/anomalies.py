"""Anomaly, indicator and correlation queries (section 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsignal.operators import anomaly, correlate, scan
from opsignal.plans.derived import SIG, signals
from opsignal.plans.registry import query

# hourly sum per event type (whole numbers, so that sums are exact in both engines), weekday and hour
BASE = f"""{SIG}, base AS (SELECT event_type AS metric, date_trunc('hour', ts)::TIMESTAMP AS hour_bucket, CAST(sum(k) AS DOUBLE) AS value,
  CAST(isodow(date_trunc('hour', ts)) - 1 AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hod FROM sig GROUP BY ALL)"""


def base(t):
    return anomaly.hourly_baseline(
        signals(t).withColumnRenamed("event_type", "metric"), ["metric"], "ts", F.sum("k").cast("double")
    )


@query(
    "seasonal_ratio",
    f"""WITH {BASE}, w AS (SELECT *, avg(value) OVER p AS baseline_avg, count(*) OVER p AS n FROM base
          WINDOW p AS (PARTITION BY metric, dow, hod ORDER BY hour_bucket RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING))
        SELECT metric, hour_bucket, value, round(baseline_avg, 4) AS baseline_avg, round(value / baseline_avg, 8) AS ratio,
          value / baseline_avg >= 3 AS is_anomaly FROM w WHERE n >= 2""",
)
def _(t):
    out = anomaly.seasonal_ratio(base(t), ["metric"], min_points=2)
    return out.select("metric", "hour_bucket", "value", F.round("baseline_avg", 4).alias("baseline_avg"), F.round("ratio", 8).alias("ratio"), "is_anomaly")


@query(
    "iqr_anomaly",
    f"""WITH {BASE}, w AS (SELECT *, quantile_cont(value, 0.25) OVER p AS q1, quantile_cont(value, 0.75) OVER p AS q3, count(*) OVER p - 1 AS n FROM base
          WINDOW p AS (PARTITION BY metric ORDER BY hour_bucket RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))
        SELECT metric, hour_bucket, value, round(q1, 4) AS q1, round(q3, 4) AS q3 FROM w
        WHERE n >= 10 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))""",
)
def _(t):
    out = anomaly.iqr_anomaly(base(t), ["metric"])
    return out.select("metric", "hour_bucket", "value", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"))


# the same with holes in two hours of some days, single high hours and a higher level from a day on, so that the shipped fences are passed
HOLES = "NOT (hour(ts) IN (3, 11) AND day(ts) % 9 = 4)"
SPIKE = "CASE WHEN hour(ts) = 17 AND day(ts) IN (6, 19) THEN 4000 ELSE 0 END + CASE WHEN ts >= TIMESTAMP '2024-01-16 06:00:00' THEN 2500 ELSE 0 END"
GRID = f"""{SIG}, base AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS metric, date_trunc('hour', ts)::TIMESTAMP AS hour_bucket,
    CAST(sum(k) + max({SPIKE}) AS DOUBLE) AS value FROM sig WHERE {HOLES} GROUP BY ALL),
  ends AS (SELECT metric, min(hour_bucket) AS lo, max(hour_bucket) AS hi FROM base GROUP BY metric),
  hours AS (SELECT metric, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour_bucket FROM ends),
  grid AS (SELECT metric, hour_bucket, value FROM hours LEFT JOIN base USING (metric, hour_bucket))"""


def holed_base(t):
    rows = signals(t).filter(HOLES).select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("metric"), "ts", "k", F.expr(SPIKE.replace("TIMESTAMP", "TIMESTAMP_NTZ")).alias("more"))
    return anomaly.hourly_baseline(rows, ["metric"], "ts", (F.sum("k") + F.max("more")).cast("double"))


def _flagged(diff_cte: str, c: float) -> str:
    return f"""WITH {GRID}, {diff_cte}, w AS (SELECT *, quantile_cont(diff, 0.25) OVER p AS q1, quantile_cont(diff, 0.75) OVER p AS q3, count(*) OVER p - 1 AS n
          FROM d WHERE diff IS NOT NULL
          WINDOW p AS (PARTITION BY metric ORDER BY hour_bucket RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))
        SELECT metric, hour_bucket, round(diff, 4) AS diff, round(q3 + {c} * (q3 - q1), 4) AS fence FROM w
        WHERE n >= 10 AND diff > q3 + {c} * (q3 - q1) AND value IS NOT NULL"""


@query(
    "level_shift",
    _flagged(
        """d AS (SELECT metric, hour_bucket, value, CASE WHEN count(value) OVER a = 24 AND count(value) OVER b = 24 THEN quantile_cont(value, 0.5) OVER a - quantile_cont(value, 0.5) OVER b END AS diff
             FROM grid WINDOW a AS (PARTITION BY metric ORDER BY hour_bucket ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
                              b AS (PARTITION BY metric ORDER BY hour_bucket ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING))""",
        6.0,
    ),
)
def _(t):
    out = anomaly.level_shift(holed_base(t), ["metric"])
    return out.select("metric", "hour_bucket", F.round("diff", 4).alias("diff"), F.round("fence", 4).alias("fence"))


@query(
    "persist_anomaly",
    _flagged(
        """d AS (SELECT metric, hour_bucket, value, value - lag(value) OVER (PARTITION BY metric ORDER BY hour_bucket) AS diff FROM grid)""", 3.0
    ),
)
def _(t):
    out = anomaly.persist_anomaly(holed_base(t), ["metric"])
    return out.select("metric", "hour_bucket", F.round("diff", 4).alias("diff"), F.round("fence", 4).alias("fence"))


@query(
    "deviation_ratio",
    f"""WITH {BASE}, w AS (SELECT *, coalesce(avg(value) OVER (PARTITION BY metric ORDER BY hour_bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM base)
        SELECT metric, hour_bucket, value, round(m, 4) AS baseline_avg, CASE WHEN m > 0 THEN round(value / m, 8) ELSE 'inf'::DOUBLE END AS ratio FROM w""",
)
def _(t):
    out = anomaly.deviation_ratio(base(t), ["metric"])
    ratio = F.when(F.col("baseline_avg") > 0, F.round("ratio", 8)).otherwise(F.col("ratio"))
    return out.select("metric", "hour_bucket", "value", ratio.alias("ratio"), F.round("baseline_avg", 4).alias("baseline_avg"))


@query(
    "rolling_zscore",
    f"""WITH {BASE}, w AS (SELECT *, avg(value) OVER s AS ms, stddev_samp(value) OVER s AS sd, avg(value) OVER l AS ml FROM base
          WINDOW s AS (PARTITION BY metric ORDER BY hour_bucket RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW),
                 l AS (PARTITION BY metric ORDER BY hour_bucket RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND CURRENT ROW)),
        z AS (SELECT *, CASE WHEN sd > 0 THEN (value - ms) / sd END AS zs FROM w)
        SELECT metric, hour_bucket, value, round(ms, 4) AS mean_short, round(ml, 4) AS mean_long, round(zs, 4) AS zscore,
          sum(CASE WHEN zs > 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY metric ORDER BY hour_bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS sustained FROM z""",
)
def _(t):
    out = anomaly.rolling_zscore(base(t), ["metric"], limit=0.8, runs=2)
    return out.select(
        "metric", "hour_bucket", "value", "sustained", *[F.round(c, 4).alias(c) for c in ("mean_short", "mean_long", "zscore")]
    )


@query(
    "seasonal_resid",
    f"""WITH {BASE}, r AS (SELECT metric, hour_bucket, value - avg(value) OVER (PARTITION BY metric, hod) AS resid FROM base),
        z AS (SELECT *, (resid - avg(resid) OVER (PARTITION BY metric)) / stddev_samp(resid) OVER (PARTITION BY metric) AS zs FROM r)
        SELECT metric, hour_bucket, round(resid, 4) AS resid, round(zs, 4) AS zscore FROM z WHERE zs > 3""",
)
def _(t):
    out = anomaly.seasonal_residual(base(t), ["metric"])
    return out.select("metric", "hour_bucket", F.round("resid", 4).alias("resid"), F.round("zscore", 4).alias("zscore"))


@query(
    "bollinger",
    f"""WITH {BASE}, w AS (SELECT *, avg(value) OVER p AS mid, stddev_pop(value) OVER p AS sd, count(*) OVER p AS n FROM base
          WINDOW p AS (PARTITION BY metric ORDER BY hour_bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
        SELECT metric, hour_bucket, value, round(mid, 4) AS mid, round(mid + 2 * sd, 4) AS upper, round(mid - 2 * sd, 4) AS lower, value > mid + 2 * sd AS breach
        FROM w WHERE n = 20""",
)
def _(t):
    out = anomaly.bollinger(base(t), ["metric"])
    return out.select("metric", "hour_bucket", "value", "breach", *[F.round(c, 4).alias(c) for c in ("mid", "upper", "lower")])


@query(
    "rsi",
    f"""WITH {BASE}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY metric ORDER BY hour_bucket) AS dv FROM base),
        w AS (SELECT *, sum(greatest(dv, 0)) OVER p AS g, sum(greatest(-dv, 0)) OVER p AS l, count(*) OVER p AS n FROM d WHERE dv IS NOT NULL
          WINDOW p AS (PARTITION BY metric ORDER BY hour_bucket ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
        SELECT metric, hour_bucket, round(100 * g / (g + l), 4) AS rsi FROM w WHERE n = 14""",
)
def _(t):
    return anomaly.rsi(base(t), ["metric"]).select("metric", "hour_bucket", F.round("rsi", 4).alias("rsi"))


@query(
    "macd",
    f"""WITH RECURSIVE {BASE}, d AS (SELECT metric, hour_bucket, row_number() OVER o AS i, value - lag(value) OVER o AS dv FROM base
          WINDOW o AS (PARTITION BY metric ORDER BY hour_bucket)),
        e AS (SELECT metric, hour_bucket, i, dv AS f, dv AS s, 0.0::DOUBLE AS m, 0.0::DOUBLE AS g FROM d WHERE i = 2
          UNION ALL
          SELECT d.metric, d.hour_bucket, d.i, d.dv * 2.0 / 7 + e.f * 5.0 / 7, d.dv * 2.0 / 14 + e.s * 12.0 / 14,
                 (d.dv * 2.0 / 7 + e.f * 5.0 / 7) - (d.dv * 2.0 / 14 + e.s * 12.0 / 14),
                 ((d.dv * 2.0 / 7 + e.f * 5.0 / 7) - (d.dv * 2.0 / 14 + e.s * 12.0 / 14)) * 2.0 / 6 + e.g * 4.0 / 6
          FROM e JOIN d ON d.metric = e.metric AND d.i = e.i + 1)
        SELECT metric, hour_bucket, round(m, 4) AS macd, round(g, 4) AS macd_signal,
          coalesce(m > g AND lag(m) OVER o <= lag(g) OVER o, false) AS crossed FROM e WINDOW o AS (PARTITION BY metric ORDER BY i)""",
)
def _(t):
    out = anomaly.macd(base(t), ["metric"])
    return out.select("metric", "hour_bucket", F.round("macd", 4).alias("macd"), F.round("macd_signal", 4).alias("macd_signal"), "crossed")


@query(
    "hurst",
    f"""WITH {BASE}, l AS (SELECT *, 100 - row_number() OVER (PARTITION BY metric ORDER BY hour_bucket DESC) AS i FROM base),
        b AS (SELECT metric, size, i // size AS block, i, value FROM l, (SELECT unnest([10, 20, 50, 100]) AS size) WHERE i >= 0),
        c AS (SELECT *, value - avg(value) OVER p AS dev, stddev_pop(value) OVER p AS sd FROM b WINDOW p AS (PARTITION BY metric, size, block)),
        r AS (SELECT *, sum(dev) OVER (PARTITION BY metric, size, block ORDER BY i) AS cum FROM c),
        s AS (SELECT metric, size, block, (max(cum) - min(cum)) / max(sd) AS rs FROM r GROUP BY ALL),
        m AS (SELECT metric, size, avg(rs) AS rs FROM s GROUP BY ALL)
        SELECT metric, round(regr_slope(ln(rs), ln(size)), 6) AS hurst, regr_slope(ln(rs), ln(size)) > 0.6 AS is_trending FROM m GROUP BY metric""",
)
def _(t):
    return anomaly.hurst(base(t), ["metric"]).withColumn("hurst", F.round("hurst", 6))


@query(
    "lagged_pearson",
    f"""WITH {SIG}, g AS (SELECT ns, event_type AS metric, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS c, avg(value) AS v FROM sig GROUP BY ALL),
        w AS (SELECT *, c // 24 AS win, c % 24 AS i FROM g),
        s AS (SELECT a.ns, a.win, a.metric AS a, b.metric AS b, a.i - b.i AS lag, count(*) AS n, corr(a.v, b.v) AS r, stddev_pop(a.v) AS sx, stddev_pop(b.v) AS sy
              FROM w a JOIN w b ON a.ns = b.ns AND a.win = b.win AND a.metric < b.metric AND abs(a.i - b.i) <= 10 GROUP BY ALL)
        SELECT ns, make_timestamp(win * 86400000000) AS window_start, a, b, CAST(lag * 3600 AS INTEGER) AS lag_s, round(r, 4) AS r FROM s
        WHERE n >= 4 AND sx >= 1e-9 AND sy >= 1e-9
        QUALIFY row_number() OVER (PARTITION BY ns, win, a, b ORDER BY round(abs(r), 12) DESC, abs(lag), lag) = 1 AND abs(r) >= 0.7""",
)
def _(t):
    return correlate.lagged_pearson(signals(t), ["ns"], "event_type", "ts", "value", 3600, 86400)


# one day of lead-up on a five-minute grid: at most 288 points per incident and metric
LOOK = 24 * 3600
STEP = 300
OPENED = f"""{SIG}, inc AS (SELECT event_id AS incident_id, CASE WHEN k < 50 THEN 'crash' ELSE 'probe' END AS incident_type, ns, ts AS opened_at
    FROM sig WHERE event_type = 'error'),
  g AS (SELECT ns, event_type AS metric, make_timestamp(CAST(floor(epoch_us(ts) / 300000000) AS BIGINT) * 300000000) AS gt, avg(value) AS value FROM sig
        WHERE event_type <> 'error' GROUP BY ALL),
  f AS (SELECT incident_id, incident_type, inc.ns, metric, count(*) AS n, coalesce(regr_slope(value, epoch(gt) - epoch(opened_at)), 0) AS slope,
          CASE WHEN stddev_samp(value) > 1e-9 THEN greatest(max(value) - avg(value), avg(value) - min(value)) / stddev_samp(value) END AS z
        FROM inc JOIN g ON g.ns = inc.ns AND gt >= opened_at - INTERVAL 24 HOUR AND gt <= opened_at - INTERVAL 60 SECOND GROUP BY ALL HAVING count(*) >= 3),
  ind AS (SELECT incident_type, ns, metric, round(avg(slope), 6) AS slope_threshold, round(coalesce(avg(z), 0), 3) AS zscore_threshold, count(*) AS sample_count
        FROM f GROUP BY ALL HAVING count(*) >= 3 AND NOT (abs(avg(slope)) < 1e-9 AND coalesce(avg(z), 0) < 1.5))"""


def _opened(t):
    kind = F.when(F.col("k") < 50, "crash").otherwise("probe")
    return signals(t).filter("event_type = 'error'").select(
        F.col("event_id").alias("incident_id"), kind.alias("incident_type"), "ns", F.col("ts").alias("opened_at")
    )


def _features(t):
    samples = signals(t).filter("event_type <> 'error'").withColumnRenamed("event_type", "metric")
    return correlate.lead_up_features(_opened(t), samples, ["ns"], "opened_at", "ts", LOOK, 60, STEP)


@query("leading_indicators", f"WITH {OPENED} SELECT * FROM ind")
def _(t):
    return correlate.leading_indicators(_features(t), ["ns"])


@query(
    "indicator_fire",
    f"""WITH {OPENED}, live AS (SELECT f.*, opened_at AS seen_at FROM f JOIN inc USING (incident_id)),
        fired AS (SELECT live.incident_id, live.ns, live.metric, ind.incident_type, seen_at FROM live JOIN ind ON ind.ns = live.ns AND ind.metric = live.metric
          WHERE sample_count >= 10 AND ((slope_threshold > 0 AND slope > slope_threshold) OR (slope_threshold < 0 AND slope < slope_threshold) OR z > zscore_threshold))
        SELECT fired.incident_id AS observed_at, fired.ns, fired.metric, fired.incident_type, EXISTS (SELECT 1 FROM inc WHERE inc.ns = fired.ns AND inc.opened_at > fired.seen_at
          AND inc.opened_at <= fired.seen_at + INTERVAL 1 HOUR) AS confirmed FROM fired""",
)
def _(t):
    opened = _opened(t)
    features = _features(t)
    trained = correlate.leading_indicators(features, ["ns"])
    live = features.join(opened.select("incident_id", F.col("opened_at").alias("seen_at")), "incident_id").drop("incident_type")
    fired = correlate.indicator_fire(live, trained, ["ns"])
    out = correlate.confirm_predictions(fired, opened, ["ns"], "seen_at", "opened_at", 3600)
    return out.select(F.col("incident_id").alias("observed_at"), "ns", "metric", "incident_type", "confirmed")


@query(
    "metric_pair_store",
    f"""WITH {SIG}, g AS (SELECT ns, event_type AS metric, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS c, avg(value) AS v FROM sig GROUP BY ALL),
        w AS (SELECT *, c // 24 AS win, c % 24 AS i FROM g),
        s AS (SELECT a.ns, a.win, a.metric AS a, b.metric AS b, a.i - b.i AS lag, count(*) AS n, corr(a.v, b.v) AS r, stddev_pop(a.v) AS sx, stddev_pop(b.v) AS sy
              FROM w a JOIN w b ON a.ns = b.ns AND a.win = b.win AND a.metric < b.metric AND abs(a.i - b.i) <= 10 GROUP BY ALL),
        p AS (SELECT ns, win, a, b, CAST(lag * 3600 AS INTEGER) AS lag_s, round(r, 4) AS r FROM s WHERE n >= 4 AND sx >= 1e-9 AND sy >= 1e-9
              QUALIFY row_number() OVER (PARTITION BY ns, win, a, b ORDER BY round(abs(r), 12) DESC, abs(lag), lag) = 1 AND abs(r) >= 0.7)
        SELECT a, b, lag_s, count(*) AS incident_count, round(avg(abs(r)), 8) AS avg_r, arg_max(r, (win, r)) AS latest_r,
          make_timestamp(max(win)::BIGINT * 86400000000) AS last_seen FROM p GROUP BY ALL ORDER BY incident_count DESC, a, b, lag_s LIMIT 10""",
)
def _(t):
    pairs = correlate.lagged_pearson(signals(t), ["ns"], "event_type", "ts", "value", 3600, 86400)
    hits = pairs.withColumn("incident", F.concat_ws("|", "ns", "window_start"))
    early = F.col("window_start") < F.lit("2024-01-20").cast("timestamp_ntz")
    # two batches, of which the second gives the first once more
    stored = correlate.merge_hits(correlate.merge_hits(None, hits.filter(early), [], "incident", "window_start"), hits, [], "incident", "window_start")
    stored = correlate.best_pairs(stored, [], "window_start").withColumn("avg_r", F.round("avg_r", 8))
    return scan.top_k(stored, [F.col("incident_count").desc(), F.col("a"), F.col("b"), F.col("lag_s")], 10)
