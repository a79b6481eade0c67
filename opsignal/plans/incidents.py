"""Incident assembly, lifecycle and routing queries (sections 2.5 streak, 2.9)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.operators import incidents as inc
from opsignal.operators import learn, routing
from opsignal.plans.derived import INC, SIG, incidents, signals
from opsignal.plans.registry import query

ALERT_RULE = """CASE WHEN k < 30 THEN 'Terminal shell in container' WHEN k < 60 THEN 'Redirect STDOUT/STDIN to Network Connection in Container' END"""
ALERT_SOURCE = "CASE WHEN k % 3 = 0 THEN 'sre' WHEN k % 3 = 1 THEN 'probe' ELSE 'observability' END"
WINDOW = 3600

ENDS = "event_type = 'view' AND k % 10 = 0"


def alerts_sql(era: str = "0") -> str:
    """Alerts taken one by one in their order; era: number that a closing changes, so that what is before isn't open any more."""
    return f"""{SIG}, alerts AS (SELECT event_id, ns, ts, coalesce({ALERT_RULE}, '') AS rule, concat('Alert', k % 5) AS alertname, {ALERT_SOURCE} AS source
    FROM sig WHERE event_type = 'error'),
  inline AS (SELECT *, {era} AS era, row_number() OVER (PARTITION BY ns ORDER BY ts, event_id) AS i FROM alerts a),
  fold AS (SELECT ns, i, [{{'opened': ts, 'oid': event_id, 'rule': rule, 'hi': ts, 'era': era}}] AS live, event_id AS oid FROM inline WHERE i = 1
    UNION ALL SELECT ns, i, list_append(list_filter(alive, lambda x: x.oid <> coalesce(pick.oid, event_id)),
        {{'opened': coalesce(pick.opened, ts), 'oid': coalesce(pick.oid, event_id), 'rule': coalesce(pick.rule, rule), 'hi': ts, 'era': era}}), coalesce(pick.oid, event_id)
    FROM (SELECT *, list_reverse_sort(list_filter(alive, lambda x: rule = '' OR x.rule = rule))[1] AS pick
      FROM (SELECT a.ns, a.i, a.ts, a.event_id, a.rule, a.era, list_filter(f.live, lambda x: a.era = x.era AND a.ts - x.hi < INTERVAL 30 MINUTE) AS alive
        FROM fold f JOIN inline a ON a.ns = f.ns AND a.i = f.i + 1))),
  placed AS (SELECT a.*, f.oid, a.event_id = f.oid AS opens FROM inline a JOIN fold f USING (ns, i)),
  sessions AS (SELECT md5(concat(ns, '|', max(rule) FILTER (opens), '|', epoch_us(min(ts)))) AS incident_id, ns, max(rule) FILTER (opens) AS rule, min(ts) AS opened_at,
     max(ts) AS window_end, count(*) AS n_alerts, max(alertname) FILTER (opens) AS alertname, max(source) FILTER (opens) AS source, oid,
     max(CASE WHEN opens THEN 0 WHEN rule <> '' THEN 2 WHEN source IN ('sre', 'observability') THEN 1 ELSE 0 END) AS alert_rank FROM placed GROUP BY ns, oid)"""


ALERTS = alerts_sql()


def alerts(t):
    return signals(t).filter("event_type = 'error'").select(
        "event_id", "ns", "ts", F.expr(ALERT_RULE).alias("rule"), F.concat(F.lit("Alert"), (F.col("k") % 5).cast("string")).alias("alertname"),
        F.expr(ALERT_SOURCE).alias("source"),
    )


def long_signals(t):
    """Matches, patterns and anomalies in one long table."""
    k, kind = F.col("k"), F.col("event_type")
    text = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    rows = signals(t).filter((kind == "signup") & (k < 50) | (kind == "click") | (kind == "purchase") & (k >= 60))
    return rows.select(
        "ns", "ts",
        F.when(kind == "signup", "match").when(kind == "click", "pattern").otherwise("anomaly").alias("kind"),
        F.when(kind == "signup", text("rule-", 7)).when(kind == "click", text("tmpl-", 11)).otherwise(text("metric-", 5)).alias("name"),
        F.when(kind == "purchase", k / 50).otherwise(1.0).alias("weight"),
        ((kind == "click") & (k >= 80)).alias("is_novel"),
        ((kind == "click") & (k >= 90)).alias("security_correlated"),
    )


@query("incident_sessions", f"WITH RECURSIVE {ALERTS} SELECT incident_id, ns, rule, opened_at, window_end, n_alerts, alertname, source FROM sessions")
def _(t):
    out = inc.incident_sessions(alerts(t)).drop("alert_rank")
    return out


CLOSED = alerts_sql(f"(SELECT count(*) FROM sig e WHERE e.ns = a.ns AND e.ts <= a.ts AND {ENDS})")


@query(
    "incident_lifecycle",
    f"""WITH RECURSIVE {CLOSED}, r AS (SELECT ns, ts AS closed_at FROM sig WHERE {ENDS})
        SELECT incident_id, s.ns, rule, opened_at, window_end, n_alerts, closed_at, CASE WHEN closed_at IS NULL THEN 'open' ELSE 'resolved' END AS status
        FROM sessions s ASOF LEFT JOIN r ON r.ns = s.ns AND r.closed_at > s.opened_at""",
)
def _(t):
    out = inc.incident_lifecycle(alerts(t), signals(t).filter(ENDS).select("ns", "ts"))
    return out.select("incident_id", "ns", "rule", "opened_at", "window_end", "n_alerts", "closed_at", "status")


ASSEMBLED = f"""{ALERTS}, longs AS (SELECT ns, ts,
      CASE event_type WHEN 'signup' THEN 'match' WHEN 'click' THEN 'pattern' ELSE 'anomaly' END AS kind,
      CASE event_type WHEN 'signup' THEN concat('rule-', k % 7) WHEN 'click' THEN concat('tmpl-', k % 11) ELSE concat('metric-', k % 5) END AS name,
      CASE event_type WHEN 'purchase' THEN k / 50.0 ELSE 1.0 END AS weight, event_type = 'click' AND k >= 80 AS novel, event_type = 'click' AND k >= 90 AS near
    FROM sig WHERE (event_type = 'signup' AND k < 50) OR event_type = 'click' OR (event_type = 'purchase' AND k >= 60)),
  per AS (SELECT incident_id, kind, name, sum(weight) AS total, max(weight) AS peak, bool_or(novel) AS novel, bool_or(near) AS near
    FROM sessions s JOIN longs l ON (l.ns = s.ns OR kind = 'anomaly') AND l.ts >= opened_at - INTERVAL 1 HOUR AND l.ts < opened_at GROUP BY ALL),
  brought AS (SELECT DISTINCT incident_id, name FROM sessions s JOIN placed p ON p.ns = s.ns AND p.oid = s.oid
    JOIN longs l ON l.ns = p.ns AND kind = 'match' AND l.ts >= p.ts - INTERVAL 1 HOUR AND l.ts < p.ts),
  ids AS (SELECT incident_id, string_agg(name, ',' ORDER BY name) AS match_ids FROM brought GROUP BY incident_id),
  agg AS (SELECT incident_id, bool_or(kind = 'match') AS hit,
      string_agg(name, ',' ORDER BY name) FILTER (kind = 'pattern') AS templates, count(*) FILTER (kind = 'anomaly') AS n_anomalies,
      round(max(peak) FILTER (kind = 'anomaly'), 4)::DOUBLE AS top_anomaly,
      coalesce(bool_or(novel) FILTER (kind = 'pattern'), false) AS novel, coalesce(bool_or(novel AND near) FILTER (kind = 'pattern'), false) AS near FROM per GROUP BY incident_id),
  j AS (SELECT s.*, coalesce(match_ids, '') AS match_ids, coalesce(hit, false) AS hit, coalesce(templates, alertname) AS templates, coalesce(n_anomalies, 0) AS n_anomalies,
      top_anomaly, coalesce(novel, false) AS novel, coalesce(near, false) AS near FROM sessions s LEFT JOIN agg USING (incident_id) LEFT JOIN ids USING (incident_id)),
  c AS (SELECT *, CASE WHEN lower(rule) = 'terminal shell in container' THEN 'SOC/known' WHEN hit THEN 'SOC/structured' WHEN near THEN 'MIXED/escalate'
      WHEN novel AND rule <> '' THEN 'SOC/novel' WHEN novel THEN 'MIXED/novel' WHEN n_anomalies > 0 AND rule = '' THEN 'SRE/structured'
      WHEN rule <> '' THEN 'SOC/structured' WHEN source IN ('sre', 'observability') THEN 'SRE/structured' ELSE 'MIXED/structured' END AS v FROM j),
  assembled AS (SELECT *, split_part(v, '/', 2) AS route, CASE WHEN v LIKE 'SOC/%' OR alert_rank = 2 OR match_ids <> '' THEN 'SOC' WHEN v LIKE 'SRE/%' OR alert_rank = 1 THEN 'SRE'
      ELSE 'MIXED' END AS domain FROM c)"""


def assembled(t):
    return inc.assemble_incidents(alerts(t), long_signals(t), WINDOW)


@query(
    "assemble_incidents",
    f"WITH RECURSIVE {ASSEMBLED} SELECT incident_id, ns, rule, opened_at, window_end, n_alerts, match_ids, templates, n_anomalies, top_anomaly, domain, route FROM assembled",
)
def _(t):
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",")
    return assembled(t).select(
        "incident_id", "ns", "rule", "opened_at", "window_end", "n_alerts", F.array_join("match_ids", ",").alias("match_ids"),
        names("patterns", "template").alias("templates"), F.size("anomalies").cast("bigint").alias("n_anomalies"),
        F.round(F.array_max(F.transform("anomalies", lambda x: x["deviation_ratio"])), 4).alias("top_anomaly"), "domain", "route",
    )


@query(
    "incidents_top_by_domain",
    f"""WITH RECURSIVE {ASSEMBLED} SELECT domain, incident_id, ns, route, n_alerts FROM assembled
        QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n_alerts DESC, opened_at DESC, incident_id) <= 10""",
)
def _(t):
    from opsignal.operators.scan import top_k_per_group

    order = [F.col("n_alerts").desc(), F.col("opened_at").desc(), F.col("incident_id")]
    rows = assembled(t).select("domain", "incident_id", "ns", "route", "n_alerts", "opened_at")
    return top_k_per_group(rows, ["domain"], order, 10, "incident_id").drop("rank", "opened_at")


@query(
    "fast_classify",
    f"""WITH {SIG}, c AS (SELECT event_id, k < 15 AS crit, k < 30 AS rule, k % 10 = 0 AS hit, k % 7 = 0 AS novel, k % 14 = 0 AS near, k % 5 = 0 AS anom, event_type = 'view' AS infra FROM sig),
        v AS (SELECT event_id, CASE WHEN crit THEN 'SOC/known' WHEN hit THEN 'SOC/structured' WHEN novel AND near THEN 'MIXED/escalate' WHEN novel AND rule THEN 'SOC/novel'
          WHEN novel THEN 'MIXED/novel' WHEN anom AND NOT rule THEN 'SRE/structured' WHEN rule THEN 'SOC/structured' WHEN infra THEN 'SRE/structured' ELSE 'MIXED/structured' END AS v FROM c)
        SELECT event_id, split_part(v, '/', 1) AS domain, split_part(v, '/', 2) AS route FROM v""",
)
def _(t):
    k = F.col("k")
    none = F.array().cast("array<string>")
    pattern = F.struct((k % 7 == 0).alias("is_novel"), (k % 14 == 0).alias("security_correlated"))
    rows = signals(t).select(
        "event_id",
        F.when(k < 15, F.array(F.lit("TERMINAL shell in container"))).when(k < 30, F.array(F.lit("other"))).otherwise(none).alias("rules"),
        F.when(k % 10 == 0, F.array(F.lit("m"))).otherwise(none).alias("matches"), F.array(pattern).alias("patterns"),
        F.when(k % 5 == 0, F.array(F.lit("a"))).otherwise(none).alias("anomalies"),
        F.when(F.col("event_type") == "view", "sre").alias("source"),
    )
    return inc.fast_classify(rows, "rules", "matches", "patterns", "anomalies", "source").select("event_id", "domain", "route")


@query(
    "merge_domain",
    f"""WITH {INC} SELECT ns, opened_at, CASE max(CASE domain WHEN 'SOC' THEN 2 WHEN 'SRE' THEN 1 ELSE 0 END) WHEN 2 THEN 'SOC' WHEN 1 THEN 'SRE' ELSE 'MIXED' END AS domain
        FROM inc GROUP BY ns, opened_at""",
)
def _(t):
    return inc.merge_domain(incidents(t), ["ns", "opened_at"], "domain")


@query(
    "close_incidents",
    f"""WITH RECURSIVE {ALERTS}, r AS (SELECT ns, ts AS closed_at FROM sig WHERE event_type = 'view')
        SELECT incident_id, s.ns, opened_at, closed_at, CASE WHEN closed_at IS NULL THEN 'open' ELSE 'resolved' END AS status
        FROM sessions s ASOF LEFT JOIN r ON r.ns = s.ns AND r.closed_at > s.opened_at""",
)
def _(t):
    sessions = inc.incident_sessions(alerts(t)).select("incident_id", "ns", "opened_at")
    resolved = signals(t).filter("event_type = 'view'").select("ns", F.col("ts").alias("resolved_at"))
    return inc.close_incidents(sessions, resolved, "ns", "opened_at", "resolved_at")


@query(
    "stale_incidents",
    """SELECT o_orderkey AS incident_id, 'resolved' AS status, 'auto-resolved' AS outcome, TIMESTAMP '2000-01-01' AS closed_at FROM orders
       WHERE o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 2700 SECOND""",
)
def _(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("incident_id"), F.col("o_orderdate").alias("opened_at"),
        F.when(F.col("o_orderstatus") == "O", "validating").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("resolved").alias("status"),
    )
    return inc.stale_incidents(rows, dt.datetime(2000, 1, 1))


@query(
    "resume_open",
    f"""WITH {SIG} SELECT event_id AS incident_id, ns, ts AS opened_at FROM sig WHERE event_type = 'error' AND k % 4 <> 0 AND k % 3 IN (0, 1)
        AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 2 DAY""",
)
def _(t):
    k = F.col("k")
    rows = signals(t).filter("event_type = 'error'").select(
        F.col("event_id").alias("incident_id"), "ns", F.col("ts").alias("opened_at"),
        F.when(k % 4 == 0, F.col("ts")).alias("closed_at"), F.when(k % 3 == 0, "validating").when(k % 3 == 1, "remediating").otherwise("open").alias("status"),
    )
    return inc.resume_open(rows, dt.datetime(2024, 1, 20, 12), 2 * 86400).select("incident_id", "ns", "opened_at")


@query(
    "open_counts",
    f"""WITH {INC} SELECT ns, count(*) FILTER (status = 'open') AS open_total, count(*) FILTER (status = 'open' AND domain = 'SOC') AS open_soc,
        count(*) FILTER (status = 'open' AND domain = 'SRE') AS open_sre, count(*) FILTER (status = 'open' AND route = 'escalate') AS open_escalate,
        count(*) FILTER (status = 'escalated') AS escalated FROM inc GROUP BY ns""",
)
def _(t):
    return inc.open_counts(incidents(t), ["ns"])


@query(
    "clear_streak",
    f"""WITH RECURSIVE {ALERTS}, polls AS (SELECT incident_id, ns, opened_at, p FROM sessions, generate_series(1, 30) g(p)),
        d AS (SELECT incident_id, p, EXISTS (SELECT 1 FROM sig WHERE sig.ns = polls.ns AND ts > opened_at + INTERVAL 1 MINUTE * (p - 1)
                AND ts <= opened_at + INTERVAL 1 MINUTE * p) AS dirty FROM polls),
        run AS (SELECT incident_id, p, dirty, sum(CASE WHEN dirty THEN 1 ELSE 0 END) OVER (PARTITION BY incident_id ORDER BY p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS bad FROM d),
        r AS (SELECT incident_id, min(p) FILTER (p >= 10 AND bad = 0) AS first_clear, count(*) FILTER (dirty) AS dirty_polls FROM run GROUP BY incident_id)
        SELECT incident_id, CASE WHEN first_clear IS NULL THEN 'escalated' ELSE 'resolved' END AS outcome, CAST(coalesce(first_clear, 30) AS INTEGER) AS polls,
          CAST(dirty_polls AS INTEGER) AS dirty_polls FROM r""",
)
def _(t):
    sessions = inc.incident_sessions(alerts(t)).select("incident_id", "ns", "opened_at")
    noise = signals(t).select("ns", "ts")
    return inc.clear_streaks(sessions, noise, "incident_id", "ns", "opened_at", "ts").drop("ns", "opened_at")


@query(
    "heartbeat_gap",
    f"""WITH {SIG}, g AS (SELECT ns, lag(ts) OVER (PARTITION BY ns ORDER BY ts) AS last_seen, ts AS next_seen FROM sig)
        SELECT *, CAST(floor(epoch(next_seen) - epoch(last_seen)) AS BIGINT) AS silent_s FROM g WHERE next_seen - last_seen > INTERVAL 1 HOUR""",
)
def _(t):
    return inc.heartbeat_gaps(signals(t), ["ns"], "ts", 3600)


@query(
    "freshness",
    """WITH f AS (SELECT 'events' AS source_table, max(ts) AS newest, 3600 AS allowed_s FROM events
         UNION ALL SELECT 'orders', max(o_orderdate), 86400 FROM orders UNION ALL SELECT 'lineitem', max(l_shipdate), 86400 FROM lineitem)
       SELECT *, CAST(floor(epoch(TIMESTAMP '2024-01-31') - epoch(newest)) AS BIGINT) AS lag_s,
         CAST(floor(epoch(TIMESTAMP '2024-01-31') - epoch(newest)) AS BIGINT) > allowed_s AS is_stale FROM f""",
)
def _(t):
    tables = {"events": (t.events, "ts", 3600), "orders": (t.orders, "o_orderdate", 86400), "lineitem": (t.lineitem, "l_shipdate", 86400)}
    return inc.freshness(tables, dt.datetime(2024, 1, 31))


@query(
    "breaker_open",
    f"""WITH {SIG}, f AS (SELECT ns, event_id, ts FROM sig WHERE event_type = 'error')
        SELECT ns, event_id, ts FROM f a WHERE (SELECT count(*) FROM f b WHERE b.ns = a.ns AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 12 HOUR) > 3""",
)
def _(t):
    failures = signals(t).filter("event_type = 'error'").select("ns", "event_id", "ts")
    return inc.breaker_open(failures, ["ns"], "ts", "event_id", 3, 12 * 3600)


TEMPLATE = """CASE k % 9 WHEN 0 THEN 'CrashLoopBackOff restarting' WHEN 1 THEN 'OOMKilled container' WHEN 2 THEN 'ImagePullBackOff on image' WHEN 3 THEN 'Readiness probe failed'
  WHEN 4 THEN 'postgres is not ready' WHEN 5 THEN 'sentinel lost' WHEN 6 THEN 'cnpg instance down' WHEN 7 THEN 'upstream Timeout' ELSE 'other' END"""


@query(
    "select_rule",
    f"""WITH {SIG}, i AS (SELECT event_id AS incident_id, ns, ts AS opened_at, k, {TEMPLATE} AS template, CASE WHEN k < 50 THEN 'SOC' ELSE 'SRE' END AS domain,
            CASE WHEN k % 13 = 0 THEN 'Liveness Probe' ELSE 'x' END AS rule FROM sig WHERE event_type = 'error'),
        d AS (SELECT ns, ts AS deployed_at FROM sig WHERE event_type = 'purchase' AND k < 70),
        b AS (SELECT CASE WHEN k < 50 THEN 'SOC' ELSE 'SRE' END AS domain, {TEMPLATE} AS template, min(ts) AS since FROM sig WHERE event_type = 'signup' AND k % 9 IN (2, 7) GROUP BY ALL),
        e AS (SELECT i.*, EXISTS (SELECT 1 FROM d WHERE d.ns = i.ns AND d.deployed_at <= i.opened_at AND d.deployed_at >= i.opened_at - INTERVAL 30 MINUTE) AS recent, since,
              EXISTS (SELECT 1 FROM sig x WHERE x.event_type = 'view' AND x.k < 20 AND x.ns = i.ns AND x.ts < i.opened_at AND x.ts >= i.opened_at - INTERVAL 30 MINUTE) AS sentinel,
              EXISTS (SELECT 1 FROM sig x WHERE x.event_type = 'click' AND x.k < 40 AND x.ns = i.ns AND x.ts < i.opened_at AND x.ts >= i.opened_at - INTERVAL 30 MINUTE) AS probe
              FROM i LEFT JOIN b ON b.domain = i.domain AND b.template = i.template),
        c AS (SELECT *, CASE WHEN k % 9 IN (0, 1, 2, 3) AND recent THEN 'flux_rollback' WHEN rule = 'Liveness Probe' THEN 'probe_timeout'
            WHEN k % 9 = 1 THEN CASE WHEN k % 2 = 1 THEN 'upsize' ELSE 'oom_killed' END WHEN k % 9 = 0 THEN CASE WHEN sentinel THEN 'redis_sentinel_heal' WHEN probe THEN 'probe_timeout' ELSE 'crashloop_config' END WHEN k % 9 = 2 THEN 'image_pull_backoff'
            WHEN k % 9 IN (3, 7) THEN 'probe_timeout' WHEN k % 9 IN (4, 6) THEN 'cnpg_failover' WHEN k % 9 = 5 THEN 'redis_sentinel_heal' END AS r FROM e),
        l AS (SELECT *, CASE WHEN r IS NOT NULL AND since <= opened_at THEN 'postmortem_learned' ELSE r END AS r2 FROM c)
        SELECT incident_id, ns, CASE WHEN r2 = 'cnpg_failover' THEN 'k8s_self_heal' ELSE r2 END AS selected_rule FROM l""",
)
def _(t):
    s, k = signals(t), F.col("k")
    domain = F.when(k < 50, "SOC").otherwise("SRE").alias("domain")
    opened = s.filter("event_type = 'error'").select(
        F.col("event_id").alias("incident_id"), "ns", domain, F.col("ts").alias("opened_at"),
        F.array(F.when(k % 13 == 0, "Liveness Probe").otherwise("x")).alias("rules"), F.array(F.expr(TEMPLATE)).alias("templates"), (2 - k % 2).alias("replicas"),
    )
    deploys = s.filter("event_type = 'purchase' AND k < 70").select("ns", F.col("ts").alias("deployed_at"))
    runbooks = s.filter("event_type = 'signup' AND k % 9 IN (2, 7)").select(domain, F.expr(TEMPLATE).alias("template"), F.col("ts").alias("created_at"))
    # outcomes by rule: one rule never works
    outcome = F.when(k % 9 == 4, "escalated").otherwise("resolved").alias("outcome")
    rule = F.when(k % 9 == 4, "cnpg_failover").otherwise("upsize").alias("rule_name")
    rates = learn.success_rate(s.select(rule, outcome))
    pods = s.filter("event_type = 'view'").select("ns", F.when(k < 20, "cache-Sentinel-0").otherwise("web-1").alias("pod"), F.lit("CrashLoopBackOff").alias("reason"), F.col("ts").alias("seen_at"))
    failing = F.when(k < 40, "Readiness probe failed: 500").otherwise("Started container").alias("message")
    events = s.filter("event_type = 'click'").select("ns", F.lit("Unhealthy").alias("reason"), failing, F.col("ts").alias("seen_at"))
    return inc.select_rule(opened, deploys, runbooks, rates, pods=pods, events=events).select("incident_id", "ns", "selected_rule")


# --- routing -------------------------------------------------------------------------------------
ROUTE_SOURCE = "CASE WHEN event_type = 'error' THEN 'security' ELSE 'other' END"
ROUTED = f"""{SIG}, a AS (SELECT event_id, ts, ns, concat(CASE k % 3 WHEN 0 THEN 'Blackbox' WHEN 1 THEN 'SLO' ELSE 'Pod' END, k % 5) AS alertname,
     CASE WHEN k % 4 = 0 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN event_type = 'error' THEN 'security' ELSE '' END AS source,
     CASE WHEN event_type = 'view' THEN 'sre' WHEN event_type = 'signup' AND k < 20 THEN 'noc' ELSE '' END AS team, CASE WHEN event_type = 'click' THEN concat('slo-', k % 2) ELSE '' END AS slo,
     CASE WHEN event_type = 'purchase' AND k < 30 THEN 'cve-digest' WHEN event_type = 'purchase' AND k < 50 THEN 'cve-new' ELSE '' END AS alert_class FROM sig),
   m AS (SELECT *, severity = 'critical' AND NOT regexp_full_match(alertname, 'Blackbox.*|SLO.*') AS mail FROM a),
   routed AS (
     SELECT event_id, ts, 'NOC Alerts' AS receiver, alertname AS group_key, 10 AS wait_s, 300 AS interval_s, 1800 AS repeat_s, false AS muted FROM m WHERE team = 'noc'
     UNION ALL SELECT event_id, ts, 'SOC CVE Digest', alertname, 60, 82800, 82800, NOT (strftime(ts, '%H:%M') >= '05:44' AND strftime(ts, '%H:%M') < '05:52') FROM m WHERE alert_class = 'cve-digest'
     UNION ALL SELECT event_id, ts, 'SOC CVE New', alertname, 10, 3600, 86400, false FROM m WHERE alert_class = 'cve-new'
     UNION ALL SELECT event_id, ts, 'SOC Alerts', concat(alertname, '||'), 10, 300, 14400, false FROM m WHERE source = 'security' AND severity = 'critical'
     UNION ALL SELECT event_id, ts, 'SOC Alerts', concat(alertname, '||'), 10, 300, 3600, false FROM m WHERE source = 'security' AND severity <> 'critical'
     UNION ALL SELECT event_id, ts, 'SRE Alerts', concat(alertname, '|', ns), 30, 300, 14400, false FROM m WHERE team = 'sre' AND severity = 'critical'
     UNION ALL SELECT event_id, ts, 'email-critical', concat(alertname, '|', severity), 10, 3600, 1800, false FROM m WHERE mail AND source = '' AND alert_class = '' AND team <> 'noc'
     UNION ALL SELECT event_id, ts, 'SRE Alerts', concat(alertname, '|', slo), 10, 300, 3600, false FROM m WHERE slo <> '' AND severity = 'critical' AND NOT mail
     UNION ALL SELECT event_id, ts, 'SRE Alerts', concat(alertname, '|', slo), 300, 1800, 28800, false FROM m WHERE slo <> '' AND severity = 'warning'
     UNION ALL SELECT event_id, ts, 'SRE Alerts', concat(alertname, '|', ns), 30, 300, 14400, false FROM m
       WHERE alert_class = '' AND source = '' AND slo = '' AND NOT mail AND team <> 'noc' AND NOT (team = 'sre' AND severity = 'critical'))"""


def routed(t):
    k, kind = F.col("k"), F.col("event_type")
    name = F.concat(F.when(k % 3 == 0, "Blackbox").when(k % 3 == 1, "SLO").otherwise("Pod"), (k % 5).cast("string"))
    labels = F.map_filter(
        F.create_map(
            F.lit("alertname"), name, F.lit("namespace"), F.col("ns"), F.lit("severity"), F.when(k % 4 == 0, "critical").otherwise("warning"),
            F.lit("source"), F.when(kind == "error", "security"), F.lit("team"), F.when(kind == "view", "sre").when((kind == "signup") & (k < 20), "noc"),
            F.lit("slo"), F.when(kind == "click", F.concat(F.lit("slo-"), (k % 2).cast("string"))),
            F.lit("alert_class"), F.when((kind == "purchase") & (k < 30), "cve-digest").when((kind == "purchase") & (k < 50), "cve-new"),
        ),
        lambda _, v: v.isNotNull(),
    )
    rows = signals(t).select("event_id", "ts", labels.alias("labels"))
    return routing.route_alerts(rows, "labels", "ts", fv.ROUTING_POLICIES).drop("labels")


@query("route_alerts", f"WITH {ROUTED} SELECT event_id, ts, receiver, group_key, wait_s, interval_s, repeat_s, muted FROM routed")
def _(t):
    return routed(t)


@query(
    "repeat_suppress",
    f"""WITH RECURSIVE {ROUTED}, tk AS (SELECT DISTINCT receiver, group_key, interval_s, repeat_s, CAST(ceil(epoch_us(ts) / (interval_s::BIGINT * 1000000)) AS BIGINT) AS tick FROM routed WHERE NOT muted),
        o AS (SELECT *, row_number() OVER (PARTITION BY receiver, group_key, interval_s, repeat_s ORDER BY tick) AS i FROM tk),
        s AS (SELECT receiver, group_key, interval_s, repeat_s, i, tick, tick AS last_sent, true AS sends FROM o WHERE i = 1
          UNION ALL SELECT o.receiver, o.group_key, o.interval_s, o.repeat_s, o.i, o.tick, CASE WHEN (o.tick - s.last_sent) * o.interval_s >= o.repeat_s THEN o.tick ELSE s.last_sent END,
            (o.tick - s.last_sent) * o.interval_s >= o.repeat_s FROM s JOIN o ON o.receiver = s.receiver AND o.group_key = s.group_key AND o.interval_s = s.interval_s AND o.repeat_s = s.repeat_s AND o.i = s.i + 1)
        SELECT receiver, group_key, interval_s, repeat_s, make_timestamp(tick * interval_s::BIGINT * 1000000) AS sent_at FROM s WHERE sends""",
)
def _(t):
    return routing.repeat_suppress(routed(t).filter("NOT muted"), ["receiver", "group_key", "interval_s", "repeat_s"], "ts", "repeat_s", "interval_s")


@query(
    "notifications",
    f"""WITH RECURSIVE {ROUTED}, fired AS (SELECT DISTINCT concat_ws('|', receiver, group_key, interval_s, repeat_s) AS g, receiver, group_key, wait_s::BIGINT * 1000000 AS wait,
            interval_s::BIGINT * 1000000 AS interval_us, repeat_s::BIGINT * 1000000 AS repeat_us, concat('fp', event_id % 7) AS fp, epoch_us(ts) AS us FROM routed WHERE NOT muted),
        gr AS (SELECT g, any_value(receiver) AS receiver, any_value(group_key) AS group_key, any_value(wait) AS wait, any_value(interval_us) AS step, any_value(repeat_us) AS again,
            list({{'us': us, 'fp': fp}} ORDER BY us) AS alerts, max(us) AS last FROM fired GROUP BY g),
        mach AS (SELECT g, -1::BIGINT AS prev, alerts[1].us + wait AS flush, NULL::BIGINT AS sent, []::VARCHAR[] AS told, false AS sends, 0 AS n_new, 0 AS n FROM gr f
          UNION ALL SELECT g, flush, CASE WHEN len(pend) = 0 THEN later + wait ELSE flush + step END, CASE WHEN len(pend) = 0 THEN NULL WHEN due THEN flush ELSE sent END,
            CASE WHEN len(pend) = 0 THEN [] ELSE list_distinct(list_concat(told, pend)) END, due, len(fresh)::INTEGER, len(pend)::INTEGER
          FROM (SELECT *, len(pend) > 0 AND (len(fresh) > 0 OR flush - sent >= again) AS due
            FROM (SELECT *, list_filter(pend, lambda x: NOT list_contains(told, x)) AS fresh
              FROM (SELECT m.*, f.wait, f.step, f.again, f.last, list_distinct(list_transform(list_filter(f.alerts, lambda x: x.us > m.prev AND x.us <= m.flush), lambda x: x.fp)) AS pend,
                  list_min(list_transform(list_filter(f.alerts, lambda x: x.us > m.flush), lambda x: x.us)) AS later FROM mach m JOIN gr f USING (g)))) WHERE flush IS NOT NULL)
        SELECT receiver, group_key, f.step // 1000000 AS interval_s, f.again // 1000000 AS repeat_s, make_timestamp(m.prev) AS sent_at, n_new, n AS n_alerts,
          CASE WHEN n_new > 0 THEN 'new' ELSE 'repeat' END AS reason FROM mach m JOIN gr f USING (g) WHERE sends""",
)
def _(t):
    rows = routed(t).filter("NOT muted").withColumn("fp", F.concat(F.lit("fp"), (F.col("event_id") % 7).cast("string")))
    rows = rows.withColumns({c: F.col(c).cast("bigint") for c in ("wait_s", "interval_s", "repeat_s")})
    # groups that policies with other times name alike are groups of their own
    timed = rows.withColumns({"interval": F.col("interval_s"), "repeat": F.col("repeat_s")})
    out = routing.notifications(timed, ["receiver", "group_key", "interval_s", "repeat_s"], "fp", "ts", "wait_s", "interval", "repeat")
    return out.select("receiver", "group_key", "interval_s", "repeat_s", "sent_at", "n_new", "n_alerts", "reason")
