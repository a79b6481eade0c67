"""Range vectors, grids and threshold rules (section 2.5)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsignal.operators import ranges
from opsignal.plans.derived import SIG, signals
from opsignal.plans.registry import query

START, END = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)


def _ceil(step: str, col: str = "ts") -> str:
    """Evaluation time of a sample: the next multiple of the step, in DuckDB."""
    return f"(time_bucket(INTERVAL {step}, {col} + INTERVAL {step} - INTERVAL 1 MICROSECOND))"


@query(
    "count_over_time",
    f"""WITH {SIG}, g AS (SELECT DISTINCT ns, event_type, {_ceil('15 MINUTE')} AS t FROM sig)
        SELECT g.ns, g.event_type, g.t, count(*) AS count_over_time, CAST(sum(k) AS BIGINT) AS sum_over_time,
               round(avg(k), 6) AS avg_over_time, max(k) AS max_over_time
        FROM g JOIN sig s ON s.ns = g.ns AND s.event_type = g.event_type AND s.ts > g.t - INTERVAL 6 HOUR AND s.ts <= g.t GROUP BY ALL""",
)
def _(t):
    out = ranges.over_time(signals(t), ["ns", "event_type"], "ts", "k", 900, 6 * 3600)
    return out.withColumn("avg_over_time", F.round("avg_over_time", 6))


@query(
    "counter_increase",
    f"""WITH {SIG}, g AS (SELECT DISTINCT ns, {_ceil('10 MINUTE')} AS t FROM sig),
        p AS (SELECT g.ns, g.t, s.k, lag(s.k) OVER (PARTITION BY g.ns, g.t ORDER BY s.ts, s.event_id) AS prev
              FROM g JOIN sig s ON s.ns = g.ns AND s.ts > g.t - INTERVAL 6 HOUR AND s.ts <= g.t)
        SELECT ns, t, sum(CASE WHEN prev IS NULL THEN 0 WHEN k < prev THEN k ELSE k - prev END)::DOUBLE AS increase,
               round(sum(CASE WHEN prev IS NULL THEN 0 WHEN k < prev THEN k ELSE k - prev END)::DOUBLE / 21600, 8) AS rate
        FROM p GROUP BY ALL""",
)
def _(t):
    out = ranges.counter_increase(signals(t), ["ns"], "ts", "k", 600, 6 * 3600, "event_id")
    return out.withColumn("rate", F.round("rate", 8))


@query(
    "offset_compare",
    f"""WITH {SIG}, g AS (SELECT DISTINCT ns, {_ceil('1 HOUR')} AS t FROM sig)
        SELECT g.ns, g.t, count(*) FILTER (s.ts > g.t - INTERVAL 25 HOUR) AS recent,
          count(*) FILTER (s.ts <= g.t - INTERVAL 24 HOUR) AS past,
          count(*) FILTER (s.ts > g.t - INTERVAL 25 HOUR) - count(*) FILTER (s.ts <= g.t - INTERVAL 24 HOUR) AS diff
        FROM g JOIN sig s ON s.ns = g.ns AND s.ts > g.t - INTERVAL 73 HOUR AND s.ts <= g.t GROUP BY ALL""",
)
def _(t):
    return ranges.offset_compare(signals(t), ["ns"], "ts", 3600, 25 * 3600, 49 * 3600, 24 * 3600)


@query(
    "absent_series",
    f"""WITH {SIG}, days AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS t)
        SELECT p.pod, days.t FROM (SELECT DISTINCT pod FROM sig) p, days
        WHERE NOT EXISTS (SELECT 1 FROM sig s WHERE s.pod = p.pod AND s.ts > days.t - INTERVAL 1 DAY AND s.ts <= days.t)""",
)
def _(t):
    s = signals(t)
    return ranges.absent_series(s.select("pod"), s, ["pod"], "ts", 86400, START, END)


@query(
    "sustained_condition",
    f"""WITH {SIG}, g AS (SELECT ns, event_type, {_ceil('1 HOUR')} AS t, max(value) AS value FROM sig GROUP BY ALL),
        c AS (SELECT *, value > 20 AS hot, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY ns, event_type ORDER BY t) AS island FROM g),
        f AS (SELECT *, min(t) FILTER (hot) OVER (PARTITION BY ns, event_type, island) AS since FROM c)
        SELECT ns, event_type, t, value, since FROM f WHERE hot AND t >= since + INTERVAL 8 HOUR""",
)
def _(t):
    steps = ranges.step_reduce(signals(t), ["ns", "event_type"], "ts", 3600, [F.max("value").alias("value")])
    rows = steps.withColumn("t", F.timestamp_micros(F.col("step") * 3_600_000_000).cast("timestamp_ntz")).drop("step")
    return ranges.sustained(rows.withColumn("hot", F.col("value") > 20), ["ns", "event_type"], "t", "hot", 8 * 3600)


@query(
    "threshold_rules",
    f"""WITH {SIG}, g AS (SELECT ns, {_ceil('1 HOUR')} AS t, sum(value) AS used, max(value) * 3 AS capacity, min(k) AS inodes, count(*) AS n FROM sig GROUP BY ALL)
        SELECT ns, t, 'VolumeFilling' AS alert, round(1 - used / capacity, 6) AS value FROM g WHERE 1 - used / capacity < 0.1
        UNION ALL SELECT ns, t, 'InodesLow', inodes FROM g WHERE inodes <= 3
        UNION ALL SELECT ns, t, 'Busy', n FROM g WHERE n > 4""",
)
def _(t):
    steps = ranges.step_reduce(
        signals(t), ["ns"], "ts", 3600,
        [F.sum("value").alias("used"), (F.max("value") * 3).alias("capacity"), F.min("k").alias("inodes"), F.count("*").alias("n")],
    )
    rows = steps.withColumn("t", F.timestamp_micros(F.col("step") * 3_600_000_000).cast("timestamp_ntz"))
    rules = [
        ("VolumeFilling", 1 - F.col("used") / F.col("capacity"), "<", 0.1),
        ("InodesLow", F.col("inodes"), "<=", 3.0),
        ("Busy", F.col("n"), ">", 4.0),
    ]
    return ranges.threshold_rules(rows, rules, ["ns", "t"]).withColumn("value", F.round("value", 6))


@query("bucket_10m", f"WITH {SIG} SELECT ns, event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, count(*) AS n FROM sig GROUP BY ALL")
def _(t):
    return ranges.bucket_counts(signals(t), ["ns", "event_type"], "ts")


@query(
    "slope",
    f"""WITH {SIG} SELECT ns, event_type, round(coalesce(regr_slope(value, epoch(ts) - epoch(TIMESTAMP '2024-01-01')), 0) * 86400, 6) AS slope_per_day, count(*) AS n
        FROM sig GROUP BY ALL""",
)
def _(t):
    out = ranges.slope_per_second(signals(t), ["ns", "event_type"], "ts", "value", START)
    return out.select("ns", "event_type", F.round(F.col("slope") * 86400, 6).alias("slope_per_day"), "n")


@query(
    "hourly_grid",
    f"""WITH {SIG}, h AS (SELECT ns, date_trunc('hour', ts)::TIMESTAMP AS hour_bucket, count(*) AS n FROM sig GROUP BY ALL),
        e AS (SELECT ns, min(hour_bucket) AS lo, max(hour_bucket) AS hi FROM h GROUP BY ns),
        g AS (SELECT ns, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour_bucket FROM e)
        SELECT g.ns, g.hour_bucket, h.n FROM g LEFT JOIN h USING (ns, hour_bucket)""",
)
def _(t):
    hours = signals(t).groupBy("ns", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_bucket")).agg(F.count("*").alias("n"))
    return ranges.regular_grid(hours, ["ns"], "hour_bucket", 3600, ["n"])
