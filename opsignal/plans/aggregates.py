"""Aggregations (section 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsignal.functions.text import mask_variables, pattern_id
from opsignal.operators import joins, learn, rollups, scan
from opsignal.plans.derived import INC, LOGS, REW, SIG, incidents, logs, rewards, signals
from opsignal.plans.registry import query

# patterns per 10-minute bucket, the input of the rollups
PAT = f"""{LOGS}, pat AS (SELECT ns, regexp_replace(line, '[0-9]+', '<*>', 'g') AS template, time_bucket(INTERVAL 10 MINUTE, ts) AS bucket,
  left(md5(concat(ns, ':', regexp_replace(line, '[0-9]+', '<*>', 'g'))), 16) AS pattern_id, count(*) AS samples_count, min(ts) AS first_seen
  FROM logs WHERE line <> '' GROUP BY ALL)"""


def patterns(t):
    template = F.regexp_replace("line", "[0-9]+", "<*>")
    rows = logs(t).filter(F.col("line") != "").groupBy(
        "ns", template.alias("template"), F.window("ts", "10 minutes")["start"].alias("bucket")
    ).agg(F.count("*").alias("samples_count"), F.min("ts").alias("first_seen"))
    return rows.withColumn("pattern_id", pattern_id("ns", "template")).withColumn("tokens", F.split("template", " "))


@query(
    "brittleness",
    f"""WITH {INC} SELECT route, date_trunc('month', opened_at)::TIMESTAMP AS month, count(*) FILTER (status = 'escalated') AS escalated,
        count(*) AS total, round_even(count(*) FILTER (status = 'escalated') / count(*), 4) AS score FROM inc WHERE route <> '' GROUP BY ALL HAVING count(*) >= 3""",
)
def _(t):
    month = F.date_trunc("month", "opened_at").cast("timestamp_ntz")
    return learn.escalation_rate(incidents(t).withColumn("month", month), ["route", "month"])


@query(
    "rule_success_rate",
    f"""WITH {REW} SELECT rule_name, count(*) FILTER (outcome = 'resolved') AS resolved, count(*) FILTER (outcome = 'escalated') AS escalated,
        round_even(count(*) FILTER (outcome = 'resolved') / count(*) FILTER (outcome IN ('resolved', 'escalated')), 4) AS rate
        FROM rew GROUP BY rule_name HAVING count(*) FILTER (outcome IN ('resolved', 'escalated')) >= 3""",
)
def _(t):
    return learn.success_rate(rewards(t))


@query(
    "recurrence_pairs",
    f"""WITH {INC} SELECT route, ns AS service, CAST(time_bucket(INTERVAL 14 DAY, opened_at, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS period, count(*) AS cnt
        FROM inc WHERE status IN ('resolved', 'escalated') GROUP BY ALL HAVING count(*) >= 3""",
)
def _(t):
    services = F.array("ns", F.lit("second"))
    rows = incidents(t).select(
        "route", "status", F.try_element_at(services, F.lit(1)).alias("service"), F.window("opened_at", "14 days")["start"].alias("period")
    )
    return learn.recurrence(rows, ["route", "service", "period"])


@query(
    "pattern_rollup",
    f"""WITH {PAT} SELECT ns, pattern_id, template, CAST(sum(samples_count) AS BIGINT) AS total_count, min(first_seen) AS first_seen, max(first_seen) AS last_seen
        FROM pat GROUP BY ALL ORDER BY total_count DESC, pattern_id LIMIT 50""",
)
def _(t):
    rolled = rollups.pattern_rollup(patterns(t).select("ns", "pattern_id", "tokens", "samples_count", "first_seen"), ["ns"])
    return scan.top_k(rolled, [F.col("total_count").desc(), F.col("pattern_id")], 50)


@query(
    "pattern_baseline",
    f"""WITH {PAT} SELECT ns, pattern_id, round(avg(samples_count), 6) AS avg_count FROM pat WHERE bucket < TIMESTAMP '2024-01-25' GROUP BY ALL""",
)
def _(t):
    import datetime as dt

    base = rollups.pattern_baseline(patterns(t), ["ns", "pattern_id"], "bucket", F.lit(dt.datetime(2024, 1, 25)))
    return base.withColumn("avg_count", F.round("avg_count", 6))


@query(
    "prior_resolutions",
    f"""WITH {INC}, {REW} SELECT rule_name, count(DISTINCT inc.incident_id) AS times_resolved FROM inc JOIN rew USING (incident_id)
        WHERE status = 'resolved' GROUP BY rule_name""",
)
def _(t):
    from opsignal.operators.incidents import merge_arrays

    rules = merge_arrays(rewards(t).select("incident_id", F.array("rule_name").alias("r")), ["incident_id"], ["r"], "rules")
    return rollups.prior_resolutions(incidents(t).select("incident_id", "status").join(rules, "incident_id"), "rules")


@query(
    "route_distribution",
    f"WITH {INC} SELECT route, status, count(*) AS n, round(count(*) / (sum(count(*)) OVER ()), 6) AS share FROM inc GROUP BY ALL",
)
def _(t):
    return rollups.share_of_total(incidents(t), ["route", "status"])


@query(
    "pair_rollup",
    f"""WITH {REW} SELECT rule_name AS metric_a, concat('part-', l_partkey % 10) AS metric_b, count(*) AS hits, round(avg(duration_s), 4) AS avg_r
        FROM rew GROUP BY ALL ORDER BY hits DESC, metric_a, metric_b LIMIT 10""",
)
def _(t):
    pairs = rewards(t).groupBy(
        F.col("rule_name").alias("metric_a"), F.concat(F.lit("part-"), (F.col("l_partkey") % 10).cast("string")).alias("metric_b")
    ).agg(F.count("*").alias("hits"), F.round(F.avg("duration_s"), 4).alias("avg_r"))
    return scan.top_k(pairs, [F.col("hits").desc(), F.col("metric_a"), F.col("metric_b")], 10)


@query(
    "agg_by_labels",
    f"""WITH {SIG} SELECT 'by' AS kind, ns, '' AS event_type, count(*) AS n, round(sum(value), 4) AS total, min(k) AS low, max(k) AS high FROM sig GROUP BY ns
        UNION ALL SELECT 'without', ns, event_type, count(*), round(sum(value), 4), min(k), max(k) FROM sig GROUP BY ns, event_type""",
)
def _(t):
    labels = F.create_map(F.lit("ns"), F.col("ns"), F.lit("pod"), F.col("pod"), F.lit("type"), F.col("event_type"))
    rows = signals(t).select(labels.alias("labels"), "value", "k")
    aggs = [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("k").alias("low"), F.max("k").alias("high")]
    by = joins.aggregate_labels(rows, aggs, by=["ns"]).withColumn("kind", F.lit("by"))
    without = joins.aggregate_labels(rows, aggs, without=["pod"]).withColumn("kind", F.lit("without"))
    lab = F.col("labels")
    return by.unionByName(without).select(
        "kind", lab["ns"].alias("ns"), F.coalesce(lab["type"], F.lit("")).alias("event_type"), "n", "total", "low", "high"
    )


@query(
    "time_to_restore",
    f"""WITH {INC} SELECT domain, ns, round(avg(epoch(closed_at) - epoch(opened_at)), 3) AS restore_s, count(*) AS n
        FROM inc WHERE status = 'resolved' GROUP BY ALL""",
)
def _(t):
    return rollups.time_to_restore(incidents(t), ["domain", "ns"])


@query(
    "false_positive_rate",
    f"""WITH {INC}, {REW} SELECT ns, round(count(*) FILTER (NOT EXISTS (SELECT 1 FROM rew WHERE rew.incident_id = inc.incident_id)) / count(*), 6) AS false_positive_rate
        FROM inc WHERE route = 'known' GROUP BY ns""",
)
def _(t):
    acted = rewards(t).select("incident_id").distinct().withColumn("acted", F.lit(True))
    rows = incidents(t).join(acted, "incident_id", "left")
    return rollups.false_positive_rate(rows, ["ns"], F.col("acted").isNull())


@query(
    "availability",
    """SELECT count(DISTINCT time_bucket(INTERVAL 5 MINUTE, ts)) AS seen, round(count(DISTINCT time_bucket(INTERVAL 5 MINUTE, ts)) / 8640.0::DOUBLE, 6) AS availability
       FROM events WHERE ts >= '2024-01-01' AND ts < '2024-01-31'""",
)
def _(t):
    import datetime as dt

    return rollups.availability(t.events, "ts", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))


@query(
    "change_failure_rate",
    f"""WITH {SIG}, d AS (SELECT *, EXISTS (SELECT 1 FROM sig e WHERE e.ns = a.ns AND e.event_type = 'error' AND e.ts >= a.ts
          AND e.ts <= a.ts + INTERVAL 4 HOUR) AS failed FROM sig a WHERE a.event_type = 'purchase')
        SELECT ns, date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS deploys, round(count(*) FILTER (failed) / count(*), 6) AS failure_rate FROM d GROUP BY ALL""",
)
def _(t):
    s = signals(t)
    deploys = s.filter("event_type = 'purchase'").select("ns", F.col("ts").alias("deployed_at"))
    opened = s.filter("event_type = 'error'").select("ns", F.col("ts").alias("opened_at"))
    return rollups.change_failure_rate(deploys, opened, ["ns"], "deployed_at", "opened_at", 4 * 3600)


@query(
    "detect_latency_pct",
    f"""WITH {SIG}, m AS (SELECT a.ns, CAST(floor(epoch(b.ts) - epoch(a.ts)) AS BIGINT) AS d FROM (SELECT * FROM sig WHERE event_type = 'signup') a
          ASOF JOIN (SELECT * FROM sig WHERE event_type = 'error') b ON a.ns = b.ns AND b.ts >= a.ts)
        SELECT ns, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.95) AS p95 FROM m GROUP BY ns""",
)
def _(t):
    s = signals(t)
    seen = s.filter("event_type = 'signup'").select("ns", F.col("ts").alias("signal_at"))
    opened = s.filter("event_type = 'error'").select("ns", F.col("ts").alias("opened_at"))
    both = joins.asof_join(seen, opened, ["ns"], "signal_at", "opened_at", ["opened_at"], direction="forward", inclusive=True)
    return rollups.delay_percentiles(both.filter("opened_at IS NOT NULL"), ["ns"], "signal_at", "opened_at", [0.5, 0.95])


@query(
    "rollup_5m",
    f"""WITH {SIG} SELECT ns, event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, round(sum(value), 4) AS sum_value, count(*) AS n,
        min(value) AS min_value, max(value) AS max_value FROM sig GROUP BY ALL""",
)
def _(t):
    out = rollups.rollup(signals(t), ["ns", "event_type"], "ts", "value", "5 minutes")
    return out.withColumn("sum_value", F.round("sum_value", 4))


@query(
    "rollup_1h",
    f"""WITH {SIG} SELECT ns, event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, round(sum(value), 4) AS sum_value, CAST(count(*) AS BIGINT) AS n,
        min(value) AS min_value, max(value) AS max_value FROM sig GROUP BY ALL""",
)
def _(t):
    fine = rollups.rollup(signals(t), ["ns", "event_type"], "ts", "value", "5 minutes")
    return rollups.re_rollup(fine, ["ns", "event_type"], "1 hour").withColumn("sum_value", F.round("sum_value", 4))
