"""Scans, sources, log shaping, ranking (sections 2.1, 2.2, 2.6)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.text import first_technique_tag, label, message_text, namespace_of
from opsignal.operators import scan, shape
from opsignal.plans.derived import INC, LOGS, PRIORITY, REW, RULE_NAME, SIG, incidents, logs, rewards, signals
from opsignal.plans.registry import query
from opsignal.sources import payloads, sinks


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- 2.1 scans and sources ----------------------------------------------------------------------
@query(
    "scan_latest_n_per_ns",
    f"""WITH {LOGS} SELECT ns, event_id, ts, line FROM logs WHERE line <> '' AND ts BETWEEN '2024-01-01' AND '2024-02-01'
        QUALIFY row_number() OVER (PARTITION BY ns ORDER BY ts DESC, event_id DESC) <= 200""",
)
def _(t):
    rows = scan.time_range_scan(logs(t), "ts", dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), "line")
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    return scan.top_k_per_group(rows.select("ns", "event_id", "ts", "line"), ["ns"], newest, 200, "event_id").drop("rank")


@query(
    "label_semi_scan",
    f"WITH {LOGS} SELECT event_id, ns, line FROM logs WHERE job = 'runtime' AND line LIKE '%rport=444%'",
)
def _(t):
    rows = logs(t)
    streams = rows.filter(F.col("labels")["job"] == "runtime").select("stream_id").distinct()
    hits = shape.filter_lines(rows.select("event_id", "ns", "line", "stream_id"), "line", contains=["rport=444"])
    return hits.join(streams, "stream_id", "left_semi").select("event_id", "ns", "line")


@query("label_values", f"WITH {SIG} SELECT DISTINCT ns, CAST(ts AS DATE) AS day FROM sig")
def _(t):
    return scan.label_values(signals(t).withColumn("day", F.to_date("ts")), "ns", "day")


@query(
    "alerts_explode",
    f"""WITH {SIG}, two AS (
          SELECT event_id, 0 AS alert_no, 'firing' AS status, concat('Alert', k) AS alertname, ns, event_type AS source FROM sig
          UNION ALL
          SELECT event_id, 1, CASE WHEN k % 2 = 0 THEN 'resolved' ELSE 'pending' END, 'unknown', '', NULL FROM sig)
        SELECT * FROM two WHERE status IN ('firing', 'resolved')""",
)
def _(t):
    s = signals(t)
    firing = F.struct(
        F.lit("firing").alias("status"),
        F.create_map(
            F.lit("alertname"), F.concat(F.lit("Alert"), F.col("k").cast("string")),
            F.lit("namespace"), F.col("ns"), F.lit("source"), F.col("event_type"),
        ).alias("labels"),
    )
    other = F.struct(
        F.when(F.col("k") % 2 == 0, "resolved").otherwise("pending").alias("status"),
        F.create_map(F.lit("severity"), F.lit("low")).alias("labels"),
    )
    bodies = s.select("event_id", F.to_json(F.struct(F.array(firing, other).alias("alerts"))).alias("alert_body"))
    alerts = payloads.explode_alerts(bodies).filter(F.col("status").isin("firing", "resolved"))
    return alerts.select("event_id", "alert_no", "status", "alertname", "ns", "source")


@query(
    "deploy_events_normalize",
    f"""WITH {SIG}
        SELECT event_id, 'flux' AS source, 'kustomization' AS event_type, ns AS namespace, pod AS resource_name,
               concat('main@sha1:', k) AS revision, CASE WHEN k % 8 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
               'flux' AS actor, 'applied' AS message FROM sig WHERE k % 4 = 0
        UNION ALL
        SELECT event_id, 'gitlab', 'push', '', pod, left(md5(concat('c', event_id)), 12), 'pushed', concat('u', user_id),
               concat('branch=b', k, ' fix') FROM sig WHERE k % 4 = 1
        UNION ALL
        SELECT event_id, 'gitlab', 'merge_request', '', pod, '', 'merged', concat('u', user_id), concat('MR ', k)
        FROM sig WHERE k % 4 = 2""",
)
def _(t):
    s, k = signals(t), F.col("k")
    text = k.cast("string")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    repo = F.struct(F.col("pod").alias("name")).alias("repository")
    reconciled = F.to_json(F.struct(
        F.struct(F.lit("Kustomization").alias("kind"), F.col("pod").alias("name"), F.col("ns").alias("namespace")).alias("involvedObject"),
        F.when(k % 8 == 0, "error").otherwise("info").alias("severity"),
        F.lit("applied").alias("message"),
        F.struct(F.concat(F.lit("main@sha1:"), text).alias("revision")).alias("metadata"),
    ))
    pushed = F.to_json(F.struct(
        F.lit("push").alias("object_kind"), F.concat(F.lit("refs/heads/b"), text).alias("ref"), user.alias("user_name"),
        F.array(F.struct(F.md5(F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("id"), F.lit("fix").alias("message"))).alias("commits"),
        repo,
    ))
    merged = F.to_json(F.struct(
        F.lit("merge_request").alias("object_kind"), F.struct(user.alias("name")).alias("user"), repo,
        F.struct(F.lit("merged").alias("state"), F.concat(F.lit("MR "), text).alias("title")).alias("object_attributes"),
    ))
    unknown = F.to_json(F.struct(F.col("ns").alias("something")))
    body = F.when(k % 4 == 0, reconciled).when(k % 4 == 1, pushed).when(k % 4 == 2, merged).otherwise(unknown)
    return payloads.normalize_deploys(s.select("event_id", body.alias("body")))


@query(
    "incremental_since",
    f"""WITH {SIG} SELECT ns, count(*) AS new_rows, max(ts) AS newest FROM sig
        WHERE ts > TIMESTAMP '2024-01-10 11:50:00' GROUP BY ns""",
)
def _(t):
    cursor = scan.initial_cursor(dt.datetime(2024, 1, 10, 12, 0))
    fresh = scan.incremental_since(signals(t), "ts", cursor)
    return fresh.groupBy("ns").agg(F.count("*").alias("new_rows"), F.max("ts").alias("newest"))


@query(
    "latest_by_key",
    f"""WITH {SIG} SELECT ns, event_type, event_id, ts, value FROM sig
        QUALIFY row_number() OVER (PARTITION BY ns, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(t):
    rows = signals(t).select("ns", "event_type", "event_id", "ts", "value")
    return scan.latest_by_key(rows, ["ns", "event_type"], ["ts", "event_id"])


@query(
    "fold_updates",
    f"""WITH {INC}, {REW}, st AS (
          SELECT incident_id, opened_at AS changed_at, 0 AS seq, 0 AS tie, status, CAST(NULL AS VARCHAR) AS outcome, route FROM inc
          UNION ALL
          SELECT r.incident_id, r.recorded_at, r.l_linenumber, l_partkey, CASE WHEN outcome = 'failed' THEN NULL ELSE outcome END,
                 outcome, NULL FROM rew r)
        SELECT incident_id, arg_max(status, row(changed_at, seq, tie)) FILTER (status IS NOT NULL) AS status,
               arg_max(outcome, row(changed_at, seq, tie)) FILTER (outcome IS NOT NULL) AS outcome,
               arg_max(route, row(changed_at, seq, tie)) FILTER (route IS NOT NULL) AS route
        FROM st GROUP BY incident_id""",
)
def _(t):
    null = F.lit(None).cast("string")
    base = incidents(t).select(
        "incident_id", F.col("opened_at").alias("changed_at"), F.lit(0).alias("seq"), F.lit(0).cast("bigint").alias("tie"),
        "status", null.alias("outcome"), "route",
    )
    changes = rewards(t).select(
        "incident_id", F.col("recorded_at").alias("changed_at"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("tie"),
        F.when(F.col("outcome") != "failed", F.col("outcome")).alias("status"), "outcome", null.alias("route"),
    )
    version = ["changed_at", "seq", "tie"]
    return scan.fold_updates(base.union(changes), ["incident_id"], version, ["status", "outcome", "route"])


@query(
    "ttl_filter",
    f"""WITH {SIG} SELECT event_id, ns, k AS ttl_days FROM sig
        WHERE ts + INTERVAL 1 DAY * k > TIMESTAMP '2024-01-31 00:00:00'""",
)
def _(t):
    rows = signals(t).select("event_id", "ns", "ts", F.col("k").alias("ttl_days"))
    return scan.ttl_filter(rows, "ts", dt.datetime(2024, 1, 31), "ttl_days").drop("ts")


RAW_LINE = """CASE k % 5
  WHEN 0 THEN concat('{"Channel":"Security","EventID":4625,"Computer":"win-', user_id, '","Message":"logon ', k, '"}')
  WHEN 1 THEN concat('{"log":"line ', k, '","stream":"stderr"}')
  WHEN 2 THEN concat('{"kind":"Event","verb":"create","severity":"Critical","n":', k, '}')
  WHEN 3 THEN concat('ap-', k, ',6.1: hostapd[', user_id, ']: station joined ', event_id)
  ELSE concat('no structure here ', k) END"""


@query(
    "ingest_normalize",
    f"""WITH {SIG} SELECT event_id,
          CASE k % 5 WHEN 0 THEN 'windows' WHEN 1 THEN 'container' WHEN 2 THEN 'k8s-audit' ELSE 'syslog' END AS log_source,
          CASE k % 5 WHEN 0 THEN concat('win-', user_id) ELSE ns END AS host,
          CASE k % 5 WHEN 0 THEN 'Security' WHEN 1 THEN 'stderr' WHEN 2 THEN 'kube-apiserver' WHEN 3 THEN 'hostapd' END AS app,
          CASE k % 5 WHEN 2 THEN 'critical' ELSE 'info' END AS level,
          CASE k % 5 WHEN 0 THEN concat('logon ', k) WHEN 1 THEN concat('line ', k)
            WHEN 2 THEN concat('{{"kind":"Event","verb":"create","severity":"Critical","n":', k, '}}')
            WHEN 3 THEN concat('station joined ', event_id) ELSE concat('no structure here ', k) END AS message
        FROM sig""",
)
def _(t):
    raw = signals(t).select("event_id", F.col("ns").alias("conn_host"), F.expr(RAW_LINE).alias("raw"))
    return payloads.normalize_logs(raw)


BROKEN_LINE = """CASE WHEN k % 10 = 0 THEN left(props, 5) WHEN k % 11 = 0 THEN '  ' WHEN k % 13 = 0 THEN NULL WHEN k % 7 = 0 THEN concat('plain line ', k) ELSE props END"""


@query(
    "ingest_quarantine",
    f"""WITH {SIG}, r AS (SELECT event_id, {BROKEN_LINE} AS raw FROM (SELECT sig.*, props FROM sig JOIN events USING (event_id)))
        SELECT event_id, raw, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'empty' ELSE 'json' END AS fault FROM r
        WHERE raw IS NULL OR trim(raw) = '' OR (ltrim(raw) LIKE '{{%' AND NOT json_valid(raw))""",
)
def _(t):
    rows = signals(t).select("event_id", "k").join(t.events.select("event_id", "props"), "event_id")
    return payloads.split_logs(rows.select("event_id", F.lit("h").alias("conn_host"), F.expr(BROKEN_LINE).alias("raw")))[1].drop("conn_host")


@query(
    "month_lifecycle",
    """SELECT o_orderkey, o_orderdate, o_totalprice + CASE WHEN strftime(o_orderdate, '%Y-%m') = '1996-03' THEN 1000 ELSE 0 END AS o_totalprice FROM orders
       WHERE o_orderdate >= TIMESTAMP '1995-07-01' AND o_orderdate >= TIMESTAMP '1994-01-15' AND o_orderdate < TIMESTAMP '1997-01-10'""",
)
def _(t):
    """Written by month, expired, one month replaced, rows given again, then a span of months read."""
    path = sinks.work_folder(t.spark)
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    ts, sort = "o_orderdate", ["o_orderkey"]
    sinks.append_monthly(rows, path, ts, sort)
    # the last whole month before 1995-07-01 is the last that goes
    sinks.expire_months(t.spark, path, dt.datetime(1995, 7, 1) + dt.timedelta(days=100), 100)
    march = rows.filter(F.date_format(ts, "yyyy-MM") == "1996-03").withColumn("o_totalprice", F.col("o_totalprice") + 1000)
    sinks.replace_months(march, path, ts, sort)
    late = rows.filter(F.date_format(ts, "yyyy-MM").isin("1995-12", "1996-11"))
    sinks.latest_months(late, path, "o_orderkey long, o_orderdate timestamp_ntz, o_totalprice double", ts, ["o_orderkey"], "o_totalprice", sort)
    schema = "o_orderkey long, o_orderdate timestamp_ntz, o_totalprice double"
    return sinks.read_months(t.spark, path, schema, dt.datetime(1994, 1, 15), dt.datetime(1997, 1, 10), ts).drop("month")


# --- 2.2 log shaping ----------------------------------------------------------------------------
def _duck_message() -> str:
    body = "json_extract_string(j, '$.body')"
    nested = f"CASE WHEN json_type(j, '$.body') = 'VARCHAR' AND json_valid({body}) THEN CAST({body} AS JSON) END"

    def field(doc, key):
        return f"CASE WHEN json_type({doc}, '$.{key}') = 'VARCHAR' AND trim(json_extract_string({doc}, '$.{key}')) <> '' THEN json_extract_string({doc}, '$.{key}') END"

    inner = ", ".join(field("b", k) for k in fv.INNER_MESSAGE_KEYS)
    outer = ", ".join(field("j", k) for k in fv.OUTER_MESSAGE_KEYS)
    return f"""WITH {LOGS}, p AS (SELECT event_id, line, CASE WHEN line LIKE '{{%' AND json_valid(line) THEN CAST(line AS JSON) END AS j FROM logs),
        q AS (SELECT *, {nested} AS b FROM p)
        SELECT event_id, coalesce({inner}, {outer}, trim(line)) AS message FROM q"""


@query("extract_message", _duck_message())
def _(t):
    return logs(t).select("event_id", message_text("line").alias("message"))


@query(
    "label_match",
    f"""WITH {LOGS} SELECT ns, event_class, count(*) AS n FROM logs
        WHERE regexp_full_match(ns, 'ns-[0-4]') AND job <> 'audit' AND NOT regexp_full_match(pod, 'pod-1.*') GROUP BY ns, event_class""",
)
def _(t):
    matchers = [("namespace", "=~", "ns-[0-4]"), ("job", "!=", "audit"), ("pod", "!~", "pod-1.*"), ("missing", "=", "")]
    return shape.match_labels(logs(t), "labels", matchers).groupBy("ns", "event_class").agg(F.count("*").alias("n"))


@query(
    "line_filter_count",
    f"""WITH {LOGS} SELECT ns, count(*) AS n FROM logs WHERE contains(line, 'Network Connection')
        AND regexp_matches(line, 'rport=(4444|4445|1337)[^0-9]') GROUP BY ns""",
)
def _(t):
    hits = shape.filter_lines(logs(t), "line", contains=["Network Connection"], regex=["rport=(4444|4445|1337)[^0-9]"])
    return hits.groupBy("ns").agg(F.count("*").alias("n"))


@query(
    "json_field_filter",
    f"""WITH {LOGS}, p AS (SELECT ns, CASE WHEN line LIKE '{{%' THEN CAST(line AS JSON) END AS j FROM logs)
        SELECT ns, json_extract_string(j, '$.verb') AS verb, count(*) AS n FROM p
        WHERE json_extract_string(j, '$.verb') IN ('create', 'delete') AND json_extract_string(j, '$.resource') = 'secrets'
        GROUP BY ALL""",
)
def _(t):
    rows = logs(t).select("ns", shape.json_field("line", "verb").alias("verb"), shape.json_field("line", "resource").alias("resource"))
    hits = rows.filter(F.col("verb").isin("create", "delete") & (F.col("resource") == "secrets"))
    return hits.groupBy("ns", "verb").agg(F.count("*").alias("n"))


@query(
    "json_field_present",
    f"""WITH {LOGS}, p AS (SELECT ns, CASE WHEN line LIKE '{{%' THEN CAST(line AS JSON) END AS j FROM logs)
        SELECT ns, count(*) AS n FROM p WHERE coalesce(json_extract_string(j, '$.verb'), '') <> '' OR coalesce(json_extract_string(j, '$.resource'), '') <> '' GROUP BY ns""",
)
def _(t):
    rows = logs(t)
    present = [F.coalesce(shape.json_field("line", key), F.lit("")) != "" for key in ("verb", "resource")]
    return rows.filter(present[0] | present[1]).groupBy("ns").agg(F.count("*").alias("n"))


@query("namespace_from_service", f"WITH {SIG} SELECT split_part(concat(ns, '/', event_type), '/', 1) AS service_ns, count(*) AS n FROM sig GROUP BY ALL")
def _(t):
    service = F.concat_ws("/", "ns", "event_type")
    return signals(t).groupBy(namespace_of(service).alias("service_ns")).agg(F.count("*").alias("n"))


@query(
    "resolved_with_runbook",
    f"""WITH {INC}, r AS (SELECT *, CASE WHEN route IN ('known', 'structured') THEN concat('runbook-', ns) WHEN route = 'novel' THEN '' END AS runbook_ref FROM inc)
        SELECT incident_id, domain, runbook_ref, opened_at FROM r WHERE status = 'resolved' AND coalesce(runbook_ref, '') <> ''
        QUALIFY row_number() OVER (PARTITION BY domain ORDER BY opened_at DESC, incident_id) <= 5""",
)
def _(t):
    ref = F.when(F.col("route").isin("known", "structured"), F.concat(F.lit("runbook-"), "ns")).when(F.col("route") == "novel", "")
    rows = incidents(t).withColumn("runbook_ref", ref).filter((F.col("status") == "resolved") & (F.coalesce("runbook_ref", F.lit("")) != ""))
    newest = [F.col("opened_at").desc(), F.col("incident_id")]
    return scan.top_k_per_group(rows.select("incident_id", "domain", "runbook_ref", "opened_at"), ["domain"], newest, 5, "incident_id").drop("rank")


@query(
    "multi_like",
    f"""WITH {LOGS} SELECT event_id, line FROM logs WHERE event_class IN ('application', 'auth')
        AND (line LIKE '%xmrig%' OR line LIKE '%minerd%' OR line LIKE '%stratum+%')
        AND line NOT LIKE '%item=99%' AND line NOT LIKE '%TCPHandler%'""",
)
def _(t):
    rows = logs(t).filter(F.col("event_class").isin("application", "auth"))
    cond = shape.like_filter("line", ["%xmrig%", "%minerd%", "%stratum+%"], ["%item=99%", "%TCPHandler%"])
    return rows.filter(cond).select("event_id", "line")


def _duck_drop(patterns):
    return " AND ".join(f"NOT regexp_matches(line, '{p}')" for p in patterns)


@query("drop_debug", f"WITH {LOGS} SELECT event_id, ns, line FROM logs WHERE {_duck_drop(fv.DROP_LEVEL_PATTERNS)}")
def _(t):
    return shape.drop_debug(logs(t).select("event_id", "ns", "line"))


@query(
    "drop_noise",
    f"WITH {LOGS} SELECT event_id, ns, line FROM logs WHERE {_duck_drop(fv.DROP_AUDIT_PATTERNS + fv.DROP_EXEC_PATTERNS)}",
)
def _(t):
    return shape.drop_noise(logs(t).select("event_id", "ns", "line"))


@query(
    "classify_tier",
    f"""WITH {LOGS}, p AS (SELECT *, {PRIORITY} AS priority FROM logs)
        SELECT event_id,
          CASE WHEN job = 'audit' THEN 'k8s-audit' WHEN job = 'runtime' OR ns = 'ns-4' THEN 'runtime-security'
               WHEN ns IN ('ns-2', 'ns-3') THEN 'infrastructure' WHEN ns = 'ns-1' THEN 'auth' ELSE 'application' END AS event_class,
          CASE WHEN job = 'runtime' THEN CASE WHEN priority IN ('Critical', 'Emergency') THEN 'critical' WHEN priority = 'Error' THEN 'high'
                 WHEN priority = 'Warning' THEN 'medium' ELSE 'low' END
               WHEN job = 'audit' THEN CASE WHEN line LIKE '%"resource":"secrets"%' THEN 'high' ELSE 'medium' END
               WHEN ns = 'ns-4' THEN 'high' ELSE 'low' END AS tier FROM p""",
)
def _(t):
    rows = logs(t).withColumn("priority", F.expr(PRIORITY))
    out = shape.classify_tier(rows, "ns", "job", "priority", "line", ["ns-1"], ["ns-2", "ns-3"], ["ns-4"])
    return out.select("event_id", "event_class", "tier")


def _duck_last(pairs, col):
    whens = " ".join(f"WHEN regexp_full_match({col}, '{p}') THEN '{v}'" for p, v in reversed(pairs))
    return f"CASE {whens} END"


@query(
    "hint_lookup",
    f"""WITH {SIG}, r AS (SELECT ns, {RULE_NAME} AS rule_name FROM sig)
        SELECT ns, rule_name, {_duck_last(fv.REMEDIATION_HINTS, 'rule_name')} AS remediation_hint,
               {_duck_last(fv.RUNBOOK_REFS, 'rule_name')} AS runbook_ref, count(*) AS n FROM r GROUP BY ALL""",
)
def _(t):
    counts = signals(t).groupBy("ns", F.expr(RULE_NAME).alias("rule_name")).agg(F.count("*").alias("n"))
    return shape.hint_lookup(counts, "rule_name")


TAGS = """CASE WHEN k < 60 THEN concat('["container","mitre_execution","T', 1000 + k, CASE WHEN k % 2 = 0 THEN '.004' ELSE '' END, '","T1999"]')
  ELSE concat('["host","T', k, '"]') END"""


@query(
    "extract_technique",
    f"""WITH {SIG} SELECT event_id, CASE WHEN k < 60 THEN concat('T', 1000 + k, CASE WHEN k % 2 = 0 THEN '.004' ELSE '' END) ELSE '' END AS technique
        FROM sig""",
)
def _(t):
    return signals(t).select("event_id", shape.extract_technique(F.expr(TAGS)).alias("technique"))


SEVERITY = """CASE k % 8 WHEN 0 THEN 'emergency' WHEN 1 THEN 'Alert' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'error' WHEN 4 THEN 'warning'
  WHEN 5 THEN 'Notice' WHEN 6 THEN 'informational' ELSE 'debug' END"""


@query(
    "severity_fold",
    f"""WITH {SIG}, v AS (SELECT ns, {SEVERITY} AS sev FROM sig)
        SELECT ns, CASE WHEN lower(sev) IN ('emergency', 'alert', 'critical') THEN 'critical' WHEN lower(sev) = 'warning' THEN 'warn'
               WHEN lower(sev) IN ('notice', 'informational') THEN 'info' ELSE sev END AS level, count(*) AS n FROM v GROUP BY ALL""",
)
def _(t):
    return signals(t).groupBy("ns", shape.fold_severity(F.expr(SEVERITY)).alias("level")).agg(F.count("*").alias("n"))


@query(
    "first_mitre_tag",
    f"""WITH {SIG} SELECT event_id, CASE WHEN k % 3 = 0 THEN concat('attack.t', 1000 + k) WHEN k % 3 = 1 THEN concat('ATTACK.T', k, '.001') ELSE '' END AS mitre
        FROM sig""",
)
def _(t):
    k = F.col("k").cast("string")
    tags = F.array(
        F.lit("attack.execution"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("attack.t"), (F.col("k") + 1000).cast("string")))
        .when(F.col("k") % 3 == 1, F.concat(F.lit("ATTACK.T"), k, F.lit(".001"))).otherwise("attack.tactic"),
        F.when(F.col("k") % 3 == 2, "other").otherwise("attack.t9999"),
    )
    return signals(t).select("event_id", first_technique_tag(tags).alias("mitre"))


@query(
    "infer_platform",
    f"""WITH {LOGS} SELECT event_id, CASE WHEN k % 11 = 0 THEN 'windows' WHEN line LIKE '%CrashLoop%' OR line LIKE '%Pod%' THEN 'kubernetes'
          WHEN k % 2 = 0 THEN 'kubernetes' ELSE 'linux' END AS platform FROM logs""",
)
def _(t):
    rules = F.array(F.when(F.col("k") % 11 == 0, "Windows_rule").otherwise("rule"))
    services = F.array(F.when(F.col("k") % 2 == 0, F.concat_ws("/", "ns", "pod")).otherwise(F.col("ns")))
    return logs(t).select("event_id", shape.infer_platform(rules, F.array("line"), F.array(F.lit("none")), services).alias("platform"))


@query(
    "attack_enrich",
    f"""WITH {SIG}, inc AS (SELECT concat(ns, '/', CAST(ts AS DATE)) AS incident, list_sort(list(DISTINCT k)) AS rules FROM sig GROUP BY ALL),
        r AS (SELECT incident, unnest(rules) AS rule_id, generate_subscripts(rules, 1) AS pos FROM inc),
        f AS (SELECT incident, p_brand AS tid, min(pos) AS pos FROM r JOIN part ON p_partkey = rule_id GROUP BY ALL),
        m AS (SELECT p_brand AS tid, min(p_name) AS name, max(p_type) AS tactic FROM part GROUP BY p_brand)
        SELECT incident, count(*) AS n_techniques,
               string_agg(concat(upper(f.tid), ' ', name, ' [', tactic, ']'), '; ' ORDER BY pos, upper(f.tid)) AS context
        FROM f JOIN m ON m.tid = f.tid GROUP BY incident""",
)
def _(t):
    per_day = signals(t).groupBy(F.concat_ws("/", "ns", F.to_date("ts").cast("string")).alias("incident")).agg(
        F.array_sort(F.collect_set(F.col("k").cast("bigint"))).alias("rules")
    )
    index = t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("tid"))
    techniques = t.part.groupBy(F.col("p_brand").alias("tid")).agg(F.min("p_name").alias("name"), F.max("p_type").alias("tactic"))
    return shape.attack_enrich(per_day, "incident", "rules", index, techniques)


# --- 2.6 ranking --------------------------------------------------------------------------------
@query("topk", f"WITH {INC} SELECT incident_id, ns, o_totalprice FROM inc ORDER BY o_totalprice DESC, incident_id LIMIT 50")
def _(t):
    rows = incidents(t).select("incident_id", "ns", "o_totalprice")
    return scan.top_k(rows, [F.col("o_totalprice").desc(), F.col("incident_id")], 50)


@query(
    "recent_incidents",
    f"""WITH {INC}, {REW}, a AS (SELECT incident_id, count(DISTINCT rule_name) AS n_rules FROM rew GROUP BY incident_id)
        SELECT inc.incident_id, opened_at, status, coalesce(n_rules, 0) AS n_rules FROM inc LEFT JOIN a USING (incident_id)
        ORDER BY opened_at DESC, inc.incident_id DESC LIMIT 20""",
)
def _(t):
    newest = scan.top_k(
        incidents(t).select("incident_id", "opened_at", "status"), [F.col("opened_at").desc(), F.col("incident_id").desc()], 20
    )
    rules = rewards(t).join(newest.select("incident_id"), "incident_id", "left_semi").groupBy("incident_id").agg(
        F.collect_set("rule_name").alias("rules")
    )
    n = F.when(F.col("rules").isNull(), 0).otherwise(F.size("rules")).cast("bigint")
    return newest.join(rules, "incident_id", "left").select("incident_id", "opened_at", "status", n.alias("n_rules"))


@query(
    "recent_closed",
    f"""WITH {INC} SELECT incident_id, opened_at, status, domain FROM inc
        WHERE status IN ('resolved', 'escalated') AND opened_at > TIMESTAMP '2001-08-02' - INTERVAL 30 DAY
        ORDER BY opened_at DESC, incident_id LIMIT 50""",
)
def _(t):
    closed = incidents(t).filter(F.col("status").isin("resolved", "escalated"))
    recent = scan.incremental_since(closed, "opened_at", dt.datetime(2001, 8, 2) - dt.timedelta(days=30))
    rows = recent.select("incident_id", "opened_at", "status", "domain")
    return scan.top_k(rows, [F.col("opened_at").desc(), F.col("incident_id")], 50)


@query(
    "memory_search",
    """SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' AND text ILIKE '%tion%'
       ORDER BY conv_id DESC, turn DESC LIMIT 100""",
)
def _(t):
    hits = scan.search_text(t.conversations, "text", "TION", F.col("role") == "user")
    return scan.top_k(hits.select("conv_id", "turn", "role", "text"), [F.col("conv_id").desc(), F.col("turn").desc()], 100)
