"""Error-budget queries (section 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsignal.operators import slo
from opsignal.plans.derived import SIG, signals
from opsignal.plans.ranges import _ceil
from opsignal.plans.registry import query


def _ratios(step: str, windows: list[tuple[str, str]], bad: str) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT ns, t, '{w}' AS win, CAST(sum(bad) OVER (PARTITION BY ns ORDER BY t RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW) AS BIGINT) AS bad,
            CAST(sum(total) OVER (PARTITION BY ns ORDER BY t RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM g"""
        for w, span in windows
    )
    return f"""{SIG}, g AS (SELECT ns, {_ceil(step)} AS t, count(*) FILTER ({bad}) AS bad, count(*) AS total FROM sig GROUP BY ALL),
        x AS ({parts}), ratios AS (SELECT *, bad / total AS ratio FROM x)"""


# counters of each namespace and event type that start anew every day
COUNTERS = "sum(k) OVER (PARTITION BY ns, event_type, CAST(ts AS DATE) ORDER BY ts, event_id)"


def _counted(windows: list[tuple[str, str]]) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT ns, t, '{w}' AS win, sum(bad) OVER (PARTITION BY ns ORDER BY t RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW)::DOUBLE AS bad,
            sum(total) OVER (PARTITION BY ns ORDER BY t RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW)::DOUBLE AS total FROM g"""
        for w, span in windows
    )
    return f"""{SIG}, c AS (SELECT *, {COUNTERS} AS v FROM sig), p AS (SELECT *, lag(v) OVER (PARTITION BY ns, event_type ORDER BY ts, event_id) AS past FROM c),
        u AS (SELECT ns, {_ceil("5 MINUTE")} AS t, event_type = 'error' AS bad, CASE WHEN past IS NULL THEN 0 WHEN v < past THEN v ELSE v - past END AS up FROM p),
        g AS (SELECT ns, t, coalesce(sum(up) FILTER (bad), 0) AS bad, sum(up) AS total FROM u GROUP BY ALL),
        x AS ({parts}), ratios AS (SELECT *, CASE WHEN total <> 0 THEN bad / total END AS ratio FROM x)"""


# a window of n steps reaches n - 1 steps back from the current one
REQ = _ratios("5 MINUTE", [("5m", "0 MINUTE"), ("30m", "25 MINUTE"), ("1h", "55 MINUTE"), ("2h", "115 MINUTE"), ("6h", "355 MINUTE"),
                           ("1d", "1435 MINUTE"), ("3d", "4315 MINUTE")], "event_type = 'error'")
COUNTED = _counted([("5m", "0 MINUTE"), ("30m", "25 MINUTE"), ("1h", "55 MINUTE"), ("2h", "115 MINUTE"), ("6h", "355 MINUTE"),
                    ("1d", "1435 MINUTE"), ("3d", "4315 MINUTE"), ("30d", "43195 MINUTE")])
PROBE = _ratios("3 MINUTE", [("3m", "0 MINUTE"), ("15m", "12 MINUTE"), ("30m", "27 MINUTE"), ("1h", "57 MINUTE"), ("3h", "177 MINUTE"),
                             ("12h", "717 MINUTE"), ("2d", "2877 MINUTE")], "event_type = 'error'")


def _requests(t):
    return slo.error_ratios(signals(t), ["ns"], "ts", F.col("event_type") == "error", slo.REQUEST_WINDOWS, 300)


def _counters(t):
    samples = signals(t).withColumn("v", F.expr(COUNTERS))
    return slo.counter_steps(samples, ["ns"], ["event_type"], "ts", "v", F.col("event_type") == "error", 300, "event_id")


@query("slo_error_ratio", f"WITH {COUNTED} SELECT ns, t, win, bad, total, round(ratio, 8) AS ratio FROM ratios")
def _(t):
    return slo.counter_ratios(_counters(t), ["ns"], [*slo.REQUEST_WINDOWS, slo.PERIOD], 300).withColumn("ratio", F.round("ratio", 8))


@query(
    "slo_burn_rate",
    f"""WITH {REQ} SELECT ns, t, win, round(ratio / (1 - 0.9::DOUBLE), 8) AS burn_rate, round(1 - ratio / (1 - 0.9::DOUBLE), 8) AS budget_remaining
        FROM ratios WHERE win IN ('6h', '3d')""",
)
def _(t):
    ratios = slo.error_ratios(signals(t), ["ns"], "ts", F.col("event_type") == "error", ["6h", "3d"], 300)
    out = slo.burn_rates(ratios, 0.9)
    return out.select("ns", "t", "win", F.round("burn_rate", 8).alias("burn_rate"), F.round("budget_remaining", 8).alias("budget_remaining"))


@query(
    "slo_multiwindow_alert",
    f"""WITH {REQ}, p AS (SELECT ns, t, {', '.join(f"max(ratio) FILTER (win = '{w}') AS r_{w}" for w in slo.REQUEST_WINDOWS)} FROM ratios GROUP BY ALL),
        b AS (SELECT 1 - 0.95::DOUBLE AS budget),
        a AS (SELECT ns, t, (r_5m > 14.4 * budget AND r_1h > 14.4 * budget) OR (r_30m > 6 * budget AND r_6h > 6 * budget) AS page,
                (r_2h > 3 * budget AND r_1d > 3 * budget) OR (r_6h > budget AND r_3d > budget) AS ticket FROM p, b)
        SELECT * FROM a WHERE page OR ticket""",
)
def _(t):
    return slo.request_alerts(_requests(t), ["ns"], 0.95)


@query(
    "probe_burn",
    f"""WITH {PROBE}, p AS (SELECT ns, t, {', '.join(f"max(ratio) FILTER (win = '{w}') AS r_{w}" for w in slo.PROBE_WINDOWS)} FROM ratios GROUP BY ALL),
        b AS (SELECT 1 - 0.95::DOUBLE AS budget),
        a AS (SELECT ns, t, (r_3m > 14 * budget AND r_30m > 14 * budget) OR (r_15m > 7 * budget AND r_3h > 7 * budget) AS critical,
                (r_1h > 2 * budget AND r_12h > 2 * budget) OR (r_3h > budget AND r_2d > budget) AS warning FROM p, b)
        SELECT * FROM a WHERE critical OR warning""",
)
def _(t):
    ratios = slo.error_ratios(signals(t), ["ns"], "ts", F.col("event_type") == "error", slo.PROBE_WINDOWS, 180)
    return slo.probe_alerts(ratios, ["ns"], 0.95)


@query(
    "slo_period_budget",
    f"""WITH {COUNTED}, m AS (SELECT ns, t, avg(ratio) OVER (PARTITION BY ns ORDER BY t RANGE BETWEEN INTERVAL 43195 MINUTE PRECEDING AND CURRENT ROW) AS period_ratio
          FROM ratios WHERE win = '5m' AND ratio IS NOT NULL)
        SELECT ns, t, round(period_ratio, 6) AS period_ratio, round(period_ratio / (1 - 0.9::DOUBLE), 6) AS period_burn_rate,
          round(1 - period_ratio / (1 - 0.9::DOUBLE), 6) AS budget_remaining FROM m""",
)
def _(t):
    ratios = slo.counter_ratios(_counters(t), ["ns"], ["5m"], 300)
    out = slo.period_budgets(ratios, ["ns"], 0.9, 300)
    return out.select("ns", "t", *[F.round(c, 6).alias(c) for c in ("period_ratio", "period_burn_rate", "budget_remaining")])
