"""Error budgets: error ratios over many windows, burn rates and multi-window alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.text import any_of
from opsignal.functions.timecells import SECOND, cell_time, epoch_us, eval_cell, whole_cells
from opsignal.operators.ranges import range_sums, step_reduce

REQUEST_WINDOWS = ["5m", "30m", "1h", "2h", "6h", "1d", "3d"]
PERIOD = "30d"
PROBE_WINDOWS = ["3m", "15m", "30m", "1h", "3h", "12h", "2d"]


def error_ratios(
    df: DataFrame, keys: list[str], ts: str, bad: Column, windows: list[str], step_s: int
) -> DataFrame:
    """bad / total over every trailing window, at every step that saw a request; null when there is none.

    Requests are summed per step once; all windows come out of one running sum.
    """
    steps = step_reduce(df, keys, ts, step_s, [F.count_if(bad).alias("bad"), F.count("*").alias("total")])
    sums = range_sums(steps, keys, ["bad", "total"], windows, step_s)
    ratio = F.col("bad") / F.when(F.col("total") != 0, F.col("total"))
    return sums.select(*keys, cell_time("step", step_s).alias("t"), "win", "bad", "total", ratio.alias("ratio"))


def counter_steps(
    samples: DataFrame, keys: list[str], series: list[str], ts: str, value: str, bad: Column, step_s: int, tiebreak: str, sample_s: int = 15
) -> DataFrame:
    """keys, step, bad, total: by how much the counters of a key went up in (t - step, t].

    samples: one row per scrape of a counter, which keys and series name; bad: whether it counts errors. What a counter has gained
    since the sample before counts at the later one; after a reset the new value itself; a counter's first sample gains nothing.
    Samples are ordered inside short cells (sample_s, which must divide step_s); across cells first and last values are enough.
    """
    jump = lambda prev, v: F.when(v < prev, v).otherwise(v - prev)
    name = [*keys, *series]
    inside = Window.partitionBy(*name, "_c").orderBy(ts, tiebreak)
    rows = samples.select(*name, ts, tiebreak, F.col(value).cast("double").alias("_v"), bad.alias("_bad"), eval_cell(ts, sample_s).alias("_c"))
    rows = rows.withColumn("_d", jump(F.lag("_v").over(inside), F.col("_v")))
    at = F.struct(ts, tiebreak)
    cells = rows.groupBy(*name, "_c").agg(
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("_within"), F.min_by("_v", at).alias("_first"), F.max_by("_v", at).alias("_last"),
        F.max("_bad").alias("_bad"),
    )
    edge = jump(F.lag("_last").over(Window.partitionBy(*name).orderBy("_c")), F.col("_first"))
    up = F.col("_within") + F.coalesce(edge, F.lit(0.0))
    gained = cells.select(*keys, "_bad", F.ceil(F.col("_c") / whole_cells(step_s, sample_s)).alias("step"), up.alias("_up"))
    return gained.groupBy(*keys, "step").agg(F.coalesce(F.sum(F.when(F.col("_bad"), F.col("_up"))), F.lit(0.0)).alias("bad"), F.sum("_up").alias("total"))


def counter_ratios(steps: DataFrame, keys: list[str], windows: list[str], step_s: int) -> DataFrame:
    """keys, t, win, bad, total, ratio over every trailing window, at every step of counter_steps(); null where nothing was counted.

    Counters without resets can be taken apart at any instant, so every window is a difference of running totals.
    """
    sums = range_sums(steps, keys, ["bad", "total"], windows, step_s)
    ratio = F.col("bad") / F.when(F.col("total") != 0, F.col("total"))
    return sums.select(*keys, cell_time("step", step_s).alias("t"), "win", "bad", "total", ratio.alias("ratio"))


def period_budgets(ratios: DataFrame, keys: list[str], objective: float, step_s: int, short: str = "5m", period: str = PERIOD) -> DataFrame:
    """keys, t, period_ratio, period_burn_rate, budget_remaining at every step: the mean of the short window's ratio over the trailing period."""
    step = F.ceil(epoch_us("t") / F.lit(step_s * SECOND)).cast("bigint")
    recorded = ratios.filter((F.col("win") == short) & F.col("ratio").isNotNull()).select(*keys, step.alias("step"), F.col("ratio").alias("_sum"), F.lit(1).cast("bigint").alias("_n"))
    mean = range_sums(recorded, keys, ["_sum", "_n"], [period], step_s).withColumn("period_ratio", F.col("_sum") / F.col("_n"))
    burn = F.col("period_ratio") / F.lit(1 - objective)
    return mean.select(*keys, cell_time("step", step_s).alias("t"), "period_ratio", burn.alias("period_burn_rate"), (1 - burn).alias("budget_remaining"))


def burn_rates(ratios: DataFrame, objective: float) -> DataFrame:
    """Ratio over the error budget, and what is left of the budget of the window."""
    burn = F.col("ratio") / F.lit(1 - objective)
    return ratios.withColumns({"burn_rate": burn, "budget_remaining": 1 - burn})


def multi_window_alert(ratios: DataFrame, keys: list[str], objective: float, pairs: list[tuple[str, float, str, str]]) -> DataFrame:
    """Per step, the severities whose short and long windows both burn too fast."""
    budget = 1 - objective
    windows = sorted({w for _, _, short, long in pairs for w in (short, long)})
    wide = ratios.groupBy(*keys, "t").agg(*[F.max(F.when(F.col("win") == w, F.col("ratio"))).alias(f"r_{w}") for w in windows])

    def fires(severity: str) -> Column:
        return any_of([
            (F.col(f"r_{short}") > factor * budget) & (F.col(f"r_{long}") > factor * budget)
            for sev, factor, short, long in pairs if sev == severity
        ])

    severities = list(dict.fromkeys(p[0] for p in pairs))
    flagged = wide.select(*keys, "t", *[F.coalesce(fires(s), F.lit(False)).alias(s) for s in severities])
    return flagged.filter(any_of([F.col(s) for s in severities]))


def request_alerts(ratios: DataFrame, keys: list[str], objective: float) -> DataFrame:
    return multi_window_alert(ratios, keys, objective, fv.REQUEST_BURN_PAIRS)


def probe_alerts(ratios: DataFrame, keys: list[str], objective: float) -> DataFrame:
    return multi_window_alert(ratios, keys, objective, fv.PROBE_BURN_PAIRS)
