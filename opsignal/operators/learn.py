"""Statistics learned from incident outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.operators.scan import top_k_per_group


def escalation_rate(incidents: DataFrame, keys: list[str], min_total: int = fv.MIN_GROUP_TOTAL) -> DataFrame:
    """Brittleness: escalated / total per key, keys with enough incidents only."""
    known = incidents.filter(F.col(keys[0]) != "")
    g = known.groupBy(*keys).agg(F.count_if(F.col("status") == "escalated").alias("escalated"), F.count("*").alias("total"))
    return g.filter(F.col("total") >= min_total).withColumn("score", F.bround(F.col("escalated") / F.col("total"), 4))


def success_rate(rewards: DataFrame, min_total: int = fv.MIN_GROUP_TOTAL) -> DataFrame:
    """resolved / (resolved + escalated) per rule, over the full history."""
    g = rewards.groupBy("rule_name").agg(
        F.count_if(F.col("outcome") == "resolved").alias("resolved"),
        F.count_if(F.col("outcome") == "escalated").alias("escalated"),
    )
    total = F.col("resolved") + F.col("escalated")
    return g.filter(total >= min_total).withColumn("rate", F.bround(F.col("resolved") / total, 4))


def recurrence(incidents: DataFrame, keys: list[str], threshold: int = 3) -> DataFrame:
    """Closed incidents that keep coming back."""
    closed = incidents.filter(F.col("status").isin("resolved", "escalated") & (F.col(keys[0]) != ""))
    return closed.groupBy(*keys).agg(F.count("*").alias("cnt")).filter(F.col("cnt") >= threshold)


def missing_rewards(incidents: DataFrame, rewards: DataFrame) -> DataFrame:
    """A negative reward for each escalated incident that has none."""
    have = rewards.filter(F.col("outcome") == "escalated").select("incident_id")
    rule = F.concat(F.coalesce("route", F.lit("unknown")), F.lit(":no_resolution"))
    return (
        incidents.filter(F.col("status") == "escalated")
        .join(have, "incident_id", "left_anti")
        .select("incident_id", rule.alias("rule_name"), F.lit("escalated").alias("outcome"))
    )


def route_matches(predicted: Column, actual: Column) -> Column:
    """Equal, or equal before the first underscore."""
    head = lambda c: F.split_part(c, F.lit("_"), F.lit(1))
    return (predicted == actual) | (head(predicted) == head(actual))


def route_feedback(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    known = df.filter((F.col(predicted) != "") & (F.col(actual) != ""))
    score = F.when(route_matches(F.col(predicted), F.col(actual)), 1.0).otherwise(0.0)
    return known.withColumn("score", score).withColumn(
        "reward", F.when(F.col("score") == 0.0, F.lit("negative_outcome_feedback"))
    )


def synthesis_gate(scores: DataFrame, recurring: DataFrame, last_run: DataFrame, as_of) -> DataFrame:
    """One row: should synthesis run? last_run(last_run TIMESTAMP) has at most one row."""
    recurring_n = recurring.agg(F.count("*")).scalar()
    last = last_run.agg(F.max("last_run")).scalar()
    one = scores.agg(F.max("score").alias("max_score"), F.count("*").alias("_n")).withColumns(
        {"n_recurring": recurring_n, "_last": last}
    )
    overdue = F.col("_last").isNull() | (F.date_diff(F.lit(as_of), "_last") >= fv.SYNTHESIS_MAX_DAYS)
    run = (F.col("n_recurring") > 0) | ((F.col("_n") > 0) & ((F.col("max_score") >= fv.SYNTHESIS_SCORE) | overdue))
    return one.select("max_score", "n_recurring", run.alias("run_synthesis"))


def outcome_rollup(outcomes: DataFrame, keys: list[str], duration: str) -> DataFrame:
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(duration), 4).alias("avg_duration"), F.max(duration).alias("max_duration")
    )


def weighted_brittleness(incidents: DataFrame, keys: list[str], similarity: str) -> DataFrame:
    """escalation rate x (1 - mean similarity)."""
    rate = F.count_if(F.col("status") == "escalated") / F.count("*")
    return incidents.groupBy(*keys).agg(F.round(rate * (1 - F.avg(similarity)), 6).alias("brittleness"))


def budgets(scores: DataFrame, key: str, budget: int = fv.REPLAY_BUDGET, most: int = fv.REPLAY_MAX) -> DataFrame:
    """Split a budget in proportion to score; each share is clamped to 1..most. scores is one row per type."""
    total = scores.agg(F.sum("score")).scalar()
    share = F.bround(F.lit(budget) * F.col("score") / F.when(total == 0, 1.0).otherwise(total))
    return scores.select(key, F.least(F.lit(most), F.greatest(F.lit(1), share.cast("int"))).alias("budget"))


def budgeted_top_k(cases: DataFrame, scores: DataFrame, key: str, order: list[Column], unique: str) -> DataFrame:
    """The first cases of each type, as many as its share of the budget."""
    first = top_k_per_group(cases, [key], order, fv.REPLAY_MAX, unique)
    return first.join(budgets(scores, key), key).filter(F.col("rank") <= F.col("budget"))


def rule_context_reward(rewards: DataFrame, context: list[str]) -> DataFrame:
    """Mean reward (1 = resolved) per rule and context."""
    return rewards.groupBy("rule_name", *context).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("outcome") == "resolved", 1.0).otherwise(0.0)).alias("mean_reward")
    )


def worst_cases(incidents: DataFrame, scores: DataFrame, key: str, types: int, per_type: int, unique: str) -> DataFrame:
    """Newest open questions of the most brittle types: top-k inside the top-k types."""
    worst = scores.orderBy(F.col("score").desc(), F.col(key)).limit(types).select(key, "score")
    order = [F.col("opened_at").desc(), F.col(unique)]
    return top_k_per_group(incidents.join(worst, key), [key], order, per_type, unique)


def runbook_rows(incidents: DataFrame, actions: DataFrame, prior: DataFrame) -> DataFrame:
    """Runbook drafts of resolved incidents as rows.

    incidents(incident_id, domain, route, services, rule_name, opened_at, status), actions(incident_id,
    step, command, output), prior(rule_name, times_resolved). Steps per incident are few.
    """
    line = F.concat(F.col("step").cast("string"), F.lit(". `"), F.col("command"), F.lit("` -> "), F.trim("output"))
    steps = actions.groupBy("incident_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "command", line.alias("line")))), lambda s: s["line"]), "\n").alias("steps")
    )
    solved = incidents.filter(F.col("status") == "resolved").join(prior, "rule_name", "left").join(steps, "incident_id", "left")
    title = F.coalesce(
        F.nullif("rule_name", F.lit("")), F.concat(F.col("domain"), F.lit(" incident in "), F.array_join("services", ", "))
    )
    return solved.select(
        "incident_id", title.alias("title"), F.date_format("opened_at", "yyyy-MM-dd").alias("first_seen"),
        F.coalesce("times_resolved", F.lit(1)).cast("bigint").alias("times_resolved"), "domain", "route",
        F.coalesce("steps", F.lit("_No automated actions recorded._")).alias("steps"),
    )
