"""Range-vector functions: trailing windows, counters, pending conditions, grids.

All of them are evaluated at steps of a grid, as alerting rules are.  Raw rows are first reduced to
one row per (series, step); ordered work then runs on at most span/step rows per series, whatever
the raw volume of the series.  Ranges are left-open and right-closed: (t - range, t].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsignal.functions.timecells import SECOND, cell_time, epoch_us, eval_cell, timespan_seconds, whole_cells


def step_reduce(df: DataFrame, keys: list[str], ts: str, step_s: int, aggs: list[Column]) -> DataFrame:
    """One row per (keys, step) with the samples of (t - step, t]."""
    return df.groupBy(*keys, eval_cell(ts, step_s).alias("step")).agg(*aggs)


def trailing(keys: list[str], steps: int, offset: int = 0):
    """Window over the last `steps` steps, optionally shifted back by `offset` steps."""
    return Window.partitionBy(*keys).orderBy("step").rangeBetween(-(steps - 1) - offset, -offset)


def over_time(
    df: DataFrame, keys: list[str], ts: str, value: str, step_s: int, range_s: int
) -> DataFrame:
    """count / sum / avg / max over time at every step that saw a sample."""
    base = step_reduce(
        df, keys, ts, step_s,
        [F.count(value).alias("_n"), F.sum(value).alias("_s"), F.max(value).alias("_m")],
    )
    w = trailing(keys, whole_cells(range_s, step_s))
    n, s = F.sum("_n").over(w), F.sum("_s").over(w)
    return base.select(
        *keys, cell_time("step", step_s).alias("t"), n.alias("count_over_time"), s.alias("sum_over_time"),
        (s / n).alias("avg_over_time"), F.max("_m").over(w).alias("max_over_time"),
    )


def counter_increase(
    df: DataFrame, keys: list[str], ts: str, value: str, step_s: int, range_s: int, tiebreak: str, sample_s: int = 15
) -> DataFrame:
    """increase() and rate() of a counter with resets, at every step that saw a sample.

    No extrapolation: the increase is the sum of the steps up between samples inside the range; after
    a reset the new value itself counts. Samples are ordered only inside short cells (about one scrape
    interval); across cells their first and last values are enough. sample_s must divide step_s.
    """
    jump = lambda prev, v: F.when(v < prev, v).otherwise(v - prev)
    cell = eval_cell(ts, sample_s).alias("_c")
    inside = Window.partitionBy(*keys, "_c").orderBy(ts, tiebreak)
    rows = df.select(*keys, ts, tiebreak, F.col(value).cast("double").alias("_v"), cell)
    rows = rows.withColumn("_d", jump(F.lag("_v").over(inside), F.col("_v")))
    at = F.struct(ts, tiebreak)
    cells = rows.groupBy(*keys, "_c").agg(
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("_within"),
        F.min_by("_v", at).alias("_first"),
        F.max_by("_v", at).alias("_last"),
    )
    edge = jump(F.lag("_last").over(Window.partitionBy(*keys).orderBy("_c")), F.col("_first"))
    cells = cells.withColumn("_edge", F.coalesce(edge, F.lit(0.0)))
    steps = cells.groupBy(*keys, F.ceil(F.col("_c") / (whole_cells(step_s, sample_s))).alias("step")).agg(
        F.sum(F.col("_within") + F.col("_edge")).alias("_up"), F.min_by("_edge", "_c").alias("_edge")
    )
    w = trailing(keys, whole_cells(range_s, step_s))
    inc = F.sum("_up").over(w) - F.first("_edge").over(w)
    return steps.select(
        *keys, cell_time("step", step_s).alias("t"), inc.alias("increase"), (inc / range_s).alias("rate")
    )


def offset_compare(
    df: DataFrame, keys: list[str], ts: str, step_s: int, range_s: int, past_range_s: int, offset_s: int
) -> DataFrame:
    """Count over a range against the count over another range shifted back by an offset."""
    base = step_reduce(df, keys, ts, step_s, [F.count("*").alias("_n")])
    now = F.sum("_n").over(trailing(keys, whole_cells(range_s, step_s)))
    past = F.coalesce(F.sum("_n").over(trailing(keys, whole_cells(past_range_s, step_s), whole_cells(offset_s, step_s))), F.lit(0))
    return base.select(
        *keys, cell_time("step", step_s).alias("t"), now.alias("recent"), past.alias("past"), (now - past).alias("diff")
    )


def absent_series(
    expected: DataFrame, observed: DataFrame, keys: list[str], ts: str, step_s: int, start, end
) -> DataFrame:
    """Expected series without a sample in a step, for every step whose end lies in (start, end]."""
    first = eval_cell(F.lit(start), step_s) + 1
    last = eval_cell(F.lit(end), step_s)
    wanted = expected.select(*keys).distinct().withColumn("step", F.explode(F.sequence(first, last)))
    seen = observed.select(*keys, eval_cell(ts, step_s).alias("step")).distinct()
    return wanted.join(seen, [*keys, "step"], "left_anti").select(*keys, cell_time("step", step_s).alias("t"))


def sustained(df: DataFrame, keys: list[str], t: str, cond: str, hold_s: float) -> DataFrame:
    """Pending period: rows where cond has been true without a break for at least hold_s.

    Expects one row per (series, evaluation step).
    """
    by_t = Window.partitionBy(*keys).orderBy(t)
    island = F.sum(F.when(F.col(cond), 0).otherwise(1)).over(by_t)
    rows = df.withColumn("_island", island)
    since = F.min(F.when(F.col(cond), F.col(t))).over(Window.partitionBy(*keys, "_island"))
    rows = rows.withColumn("since", since)
    held = (epoch_us(t) - epoch_us("since")) >= int(hold_s * SECOND)
    return rows.filter(F.col(cond) & held).drop("_island", cond)


def threshold_rules(df: DataFrame, rules: list[tuple[str, Column, str, float]], keep: list[str]) -> DataFrame:
    """All (name, expression, operator, limit) rules in one pass; one row per rule that holds."""
    ops = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}
    fired = [
        F.when(ops[op](expr, F.lit(limit)), F.struct(F.lit(name).alias("alert"), expr.cast("double").alias("value")))
        for name, expr, op, limit in rules
    ]
    out = df.select(*keep, F.explode(F.array_compact(F.array(*fired))).alias("_f"))
    return out.select(*keep, "_f.alert", "_f.value")


def bucket_counts(df: DataFrame, keys: list[str], ts: str, width: str = "10 minutes") -> DataFrame:
    return df.groupBy(*keys, F.window(ts, width)["start"].alias("bucket")).agg(F.count("*").alias("n"))


def slope_per_second(df: DataFrame, keys: list[str], ts: str, value: str, origin) -> DataFrame:
    """Least-squares slope of value on time; 0 when time does not vary."""
    x = (epoch_us(ts) - epoch_us(F.lit(origin))) / F.lit(float(SECOND))
    return df.groupBy(*keys).agg(F.coalesce(F.regr_slope(F.col(value), x), F.lit(0.0)).alias("slope"), F.count("*").alias("n"))


def range_sums(
    steps: DataFrame, keys: list[str], measures: list[str], windows: list[str], step_s: int
) -> DataFrame:
    """Sums of the measures over many trailing windows at once, in long form (keys, step, win, measures).

    Each step row enters every window at its step and leaves it window/step steps later, so one
    running sum per (series, window) gives all the windows in linear time: a 30-day window costs
    no more than a 5-minute one.
    """
    enter = [
        F.struct(F.lit(w).alias("win"), (F.col("step") + shift).alias("at"), F.lit(sign).alias("sign"))
        for w in windows
        for shift, sign in ((0, 1), (whole_cells(timespan_seconds(w), step_s), -1))
    ]
    moves = steps.select(*keys, *measures, F.explode(F.array(*enter)).alias("_e"))
    net = moves.groupBy(*keys, F.col("_e.win").alias("win"), F.col("_e.at").alias("step")).agg(
        *[F.sum(F.col(m) * F.col("_e.sign")).alias(m) for m in measures],
        F.max(F.col("_e.sign")).alias("_seen"),
    )
    running = Window.partitionBy(*keys, "win").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return net.select(
        *keys, "step", "win", *[F.sum(m).over(running).alias(m) for m in measures], "_seen"
    ).filter(F.col("_seen") == 1).drop("_seen")


def regular_grid(df: DataFrame, keys: list[str], t: str, step_s: int, cols: list[str]) -> DataFrame:
    """Every step between the first and last of each series; steps without a row have nulls."""
    ends = df.groupBy(*keys).agg(F.min(epoch_us(t)).alias("_lo"), F.max(epoch_us(t)).alias("_hi"))
    stepped = ends.select(
        *keys, F.explode(F.sequence("_lo", "_hi", F.lit(step_s * SECOND))).alias("_us")
    )
    have = df.select(*keys, epoch_us(t).alias("_us"), *cols)
    return stepped.join(have, [*keys, "_us"], "left").select(
        *keys, F.timestamp_micros("_us").cast("timestamp_ntz").alias(t), *cols
    )
