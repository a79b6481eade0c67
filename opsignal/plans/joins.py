"""Joins and set operations (section 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsignal.operators import joins, scan
from opsignal.plans.derived import INC, LOGS, REW, SIG, incidents, logs, rewards, signals
from opsignal.plans.registry import query


@query(
    "embed_join_incident",
    f"""WITH {INC} SELECT incident_id, status, domain, label, len(embedding) AS dims FROM inc
        JOIN embeddings ON vec_id = incident_id""",
)
def _(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("incident_id"), "label", F.size("embedding").cast("bigint").alias("dims"))
    return vectors.join(incidents(t).select("incident_id", "status", "domain"), "incident_id")


@query(
    "novel_patterns",
    f"""WITH {LOGS}, w AS (SELECT ns, regexp_replace(line, '[0-9]+', '<*>', 'g') AS template, CAST(ts AS DATE) AS day, count(*) AS n
          FROM logs WHERE line <> '' GROUP BY ALL),
        f AS (SELECT ns, template, min(day) AS first_day FROM w GROUP BY ALL)
        SELECT w.ns, w.template, w.n FROM w JOIN f USING (ns, template) WHERE w.day = f.first_day""",
)
def _(t):
    rows = logs(t).filter(F.col("line") != "").groupBy(
        "ns", F.regexp_replace("line", "[0-9]+", "<*>").alias("template"), F.to_date("ts").alias("day")
    ).agg(F.count("*").alias("n"))
    # novel on its first day; the ids of patterns known before are those of the days after it
    return rows.groupBy("ns", "template").agg(F.min_by("n", "day").alias("n"))


@query(
    "missing_rewards",
    f"""WITH {INC}, {REW} SELECT incident_id, concat(route, ':no_resolution') AS rule_name, 'escalated' AS outcome FROM inc
        WHERE status = 'escalated' AND NOT EXISTS (SELECT 1 FROM rew WHERE rew.incident_id = inc.incident_id AND rew.outcome = 'escalated')""",
)
def _(t):
    from opsignal.operators.learn import missing_rewards

    return missing_rewards(incidents(t), rewards(t))


@query(
    "label_intersect",
    f"""WITH {LOGS}, idx AS (SELECT DISTINCT stream_id, job, event_class, ns FROM logs)
        SELECT stream_id FROM idx WHERE job = 'runtime' INTERSECT SELECT stream_id FROM idx WHERE event_class = 'runtime-security'
        INTERSECT SELECT stream_id FROM idx WHERE ns = 'ns-3'""",
)
def _(t):
    index = scan.label_index(logs(t), "stream_id", "labels")
    return scan.streams_with(index, "stream_id", {"job": "runtime", "event_class": "runtime-security", "namespace": "ns-3"})


@query(
    "trigger_signal_interval",
    f"""WITH {SIG} SELECT a.event_id AS trigger_id, b.event_type AS signal, count(*) AS n, max(b.ts) AS latest
        FROM sig a JOIN sig b ON a.ns = b.ns AND b.ts >= a.ts - INTERVAL 10 MINUTE AND b.ts < a.ts
        WHERE a.event_type = 'error' AND b.event_type <> 'error' GROUP BY ALL""",
)
def _(t):
    s = signals(t)
    triggers = s.filter("event_type = 'error'").select("ns", F.col("event_id").alias("trigger_id"), F.col("ts").alias("trigger_ts"))
    others = s.filter("event_type <> 'error'").select("ns", F.col("event_type").alias("signal"), F.col("ts").alias("signal_ts"))
    pairs = joins.interval_join(triggers, others, ["ns"], "trigger_ts", "signal_ts", -600, 0, spread=4)
    return pairs.groupBy("trigger_id", "signal").agg(F.count("*").alias("n"), F.max("signal_ts").alias("latest"))


@query(
    "near_security_event",
    f"""WITH {SIG} SELECT a.event_id, EXISTS (SELECT 1 FROM sig b WHERE b.ns = a.ns AND b.event_type = 'error'
          AND b.ts BETWEEN a.ts - INTERVAL 300 SECOND AND a.ts + INTERVAL 300 SECOND) AS near_security
        FROM sig a WHERE a.event_type = 'click'""",
)
def _(t):
    s = signals(t)
    patterns = s.filter("event_type = 'click'").select("event_id", "ns", F.col("ts").alias("first_seen"))
    security = s.filter("event_type = 'error'").select("ns", F.col("ts").alias("seen_at"))
    flagged = joins.near_event_flag(patterns, security, ["ns"], "first_seen", "seen_at", 300, "near_security")
    return flagged.select("event_id", "near_security")


@query(
    "deploy_or_join",
    f"""WITH {SIG}, d AS (SELECT ts AS deployed_at, event_id AS deploy_id, ns, concat('ns-', k % 10) AS resource FROM sig WHERE event_type = 'purchase')
        SELECT a.event_id AS incident_id, arg_max(d.deploy_id, (d.deployed_at)) AS deploy_id, max(d.deployed_at) AS deployed_at
        FROM sig a JOIN d ON (d.ns = a.ns OR d.resource = a.ns) AND d.deployed_at >= a.ts - INTERVAL 30 MINUTE AND d.deployed_at < a.ts
        WHERE a.event_type = 'error' GROUP BY ALL""",
)
def _(t):
    s = signals(t)
    deploys = s.filter("event_type = 'purchase'").select(
        F.col("ts").alias("deployed_at"), F.col("event_id").alias("deploy_id"), F.col("ns").alias("home"),
        F.concat(F.lit("ns-"), (F.col("k") % 10).cast("string")).alias("resource"),
    )
    either = joins.either_key(deploys, "home", "resource", "ns")
    opened = s.filter("event_type = 'error'").select("ns", F.col("event_id").alias("incident_id"), F.col("ts").alias("opened_at"))
    latest = joins.asof_join(opened, either, ["ns"], "opened_at", "deployed_at", ["deployed_at", "deploy_id"], max_age_s=1800)
    return latest.filter("deploy_id IS NOT NULL").select("incident_id", "deploy_id", "deployed_at")


@query(
    "asof_latest",
    f"""WITH {SIG}, i AS (SELECT event_id, ns, ts FROM sig WHERE event_type = 'error'),
        r AS (SELECT ns, ts AS created_at, event_id AS runbook_id FROM sig WHERE event_type = 'signup')
        SELECT i.event_id, runbook_id, created_at FROM i ASOF LEFT JOIN r ON i.ns = r.ns AND i.ts >= r.created_at""",
)
def _(t):
    s = signals(t)
    opened = s.filter("event_type = 'error'").select("event_id", "ns", F.col("ts").alias("opened_at"))
    runbooks = s.filter("event_type = 'signup'").select("ns", F.col("ts").alias("created_at"), F.col("event_id").alias("runbook_id"))
    out = joins.asof_join(opened, runbooks, ["ns"], "opened_at", "created_at", ["runbook_id", "created_at"], inclusive=True)
    return out.select("event_id", "runbook_id", "created_at")


def _vector(t, event_type: str):
    s = signals(t).filter(F.col("event_type") == event_type)
    labels = F.create_map(F.lit("ns"), F.col("ns"), F.lit("pod"), F.col("pod"), F.lit("type"), F.col("event_type"))
    return s.groupBy("ns", "pod", "event_type").agg(F.sum("k").cast("double").alias("value")).select(labels.alias("labels"), "value")


def _by_ns(t, event_type: str):
    s = signals(t).filter(F.col("event_type") == event_type)
    labels = F.create_map(F.lit("ns"), F.col("ns"), F.lit("kind"), F.lit("budget"))
    return s.groupBy("ns").agg(F.sum("k").cast("double").alias("value")).select(labels.alias("labels"), "value")


@query(
    "vector_match",
    f"""WITH {SIG}, v AS (SELECT ns, pod, sum(k) AS value FROM sig WHERE event_type = 'error' GROUP BY ALL),
        b AS (SELECT ns, sum(k) AS value FROM sig WHERE event_type = 'view' GROUP BY ALL)
        SELECT v.ns, v.pod, round(v.value::DOUBLE / b.value::DOUBLE, 6) AS ratio FROM v JOIN b USING (ns)""",
)
def _(t):
    m = joins.vector_match(_vector(t, "error"), _by_ns(t, "view"), on=["ns"])
    lab = F.col("labels")
    return m.select(lab["ns"].alias("ns"), lab["pod"].alias("pod"), F.round(F.col("value") / F.col("right_value"), 6).alias("ratio"))


@query(
    "vector_and_or",
    f"""WITH {SIG}, a AS (SELECT ns, pod, sum(k)::DOUBLE AS value FROM sig WHERE event_type = 'error' GROUP BY ALL),
        b AS (SELECT ns, pod, sum(k)::DOUBLE AS value FROM sig WHERE event_type = 'view' GROUP BY ALL),
        h AS (SELECT * FROM a WHERE value > 500 AND pod IN (SELECT pod FROM b WHERE value > 500))
        SELECT ns, pod, value, 'error' AS type FROM h
        UNION ALL SELECT ns, pod, value, 'view' FROM b WHERE value <= 300 AND pod NOT IN (SELECT pod FROM h)""",
)
def _(t):
    a, b = _vector(t, "error"), _vector(t, "view")
    both = joins.vector_and(a.filter("value > 500"), b.filter("value > 500"), on=["ns", "pod"])
    out = joins.vector_or(both, b.filter("value <= 300"), on=["ns", "pod"])
    lab = F.col("labels")
    return out.select(lab["ns"].alias("ns"), lab["pod"].alias("pod"), "value", lab["type"].alias("type"))


@query(
    "vector_neq",
    f"""WITH {SIG}, c AS (SELECT pod, event_type, count(*)::DOUBLE AS value FROM sig WHERE event_type IN ('error', 'view') GROUP BY ALL)
        SELECT a.pod, a.value, b.value AS right_value FROM c a JOIN c b ON a.pod = b.pod AND a.event_type = 'error' AND b.event_type = 'view'
        WHERE a.value <> b.value""",
)
def _(t):
    s = signals(t)

    def counts(event_type):
        labels = F.create_map(F.lit("pod"), F.col("pod"), F.lit("type"), F.lit(event_type))
        return s.filter(F.col("event_type") == event_type).groupBy("pod").agg(F.count("*").cast("double").alias("value")).select(labels.alias("labels"), "value")

    out = joins.vector_not_equal(counts("error"), counts("view"), on=["pod"])
    return out.select(F.col("labels")["pod"].alias("pod"), "value", "right_value")


@query(
    "merge_arrays",
    f"""WITH {SIG} SELECT ns, CAST(ts AS DATE) AS day, string_agg(DISTINCT r, ',' ORDER BY r) AS rules FROM (
          SELECT ns, ts, concat('a-', k % 7) AS r FROM sig UNION ALL SELECT ns, ts, event_type FROM sig) GROUP BY ALL""",
)
def _(t):
    from opsignal.operators.incidents import merge_arrays

    rows = signals(t).select(
        "ns", F.to_date("ts").alias("day"),
        F.array(F.concat(F.lit("a-"), (F.col("k") % 7).cast("string"))).alias("old_rules"), F.array("event_type").alias("new_rules"),
    )
    merged = merge_arrays(rows, ["ns", "day"], ["old_rules", "new_rules"], "rules")
    return merged.withColumn("rules", F.array_join("rules", ","))
