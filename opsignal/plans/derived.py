"""Signal tables derived from the given tables, once for Spark and once as DuckDB CTE text.

Only the *inputs* are written in SQL that both engines read; the operators under test are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal.sources.tables import Tables

LINE = """CASE
  WHEN event_type = 'error' AND k < 30 THEN concat('Terminal shell in container (pod=pod-', user_id, ' k=', k, ')')
  WHEN event_type = 'error' AND k < 60 THEN concat('Redirect STDOUT/STDIN to Network Connection rport=', 4440 + k % 8, ' pod=pod-', user_id)
  WHEN event_type = 'error' THEN concat('probe timeout after ', k, 'ms: CrashLoopBackOff in pod-', user_id)
  WHEN event_type = 'click' AND k < 40 THEN concat('{"level":"debug","msg":"GET /item/', k, '"}')
  WHEN event_type = 'click' THEN concat('{"level":"info","log":7,"message":"GET /item/', k, ' took ', user_id, 'ms"}')
  WHEN event_type = 'view' AND k < 20 THEN ''
  WHEN event_type = 'view' AND k < 50 THEN concat('DEBUG view item=', k, ' user=', user_id)
  WHEN event_type = 'view' THEN concat('INFO xmrig view item=', k, ' from 10.0.', k, '.', user_id)
  WHEN event_type = 'signup' THEN concat('{"verb":"', CASE k % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'list' WHEN 2 THEN 'create' ELSE 'delete' END,
       '","stage":"', CASE WHEN k % 3 = 0 THEN 'ResponseStarted' ELSE 'ResponseComplete' END,
       '","resource":"', CASE WHEN k % 5 = 0 THEN 'secrets' ELSE 'pods' END, '"}')
  ELSE concat('{"severity":"Warning","body":"{', chr(92), '"msg', chr(92), '":', chr(92), '"order ', k, ' placed', chr(92), '"}"}')
END"""
JOB = "CASE event_type WHEN 'error' THEN 'runtime' WHEN 'signup' THEN 'audit' ELSE 'app' END"
EVENT_CLASS = "CASE event_type WHEN 'error' THEN 'runtime-security' WHEN 'signup' THEN 'k8s-audit' WHEN 'purchase' THEN 'auth' ELSE 'application' END"
RULE_NAME = """CASE k % 7 WHEN 0 THEN 'Terminal Shell in Container' WHEN 1 THEN 'Drop and execute new binary in container'
  WHEN 2 THEN 'Read sensitive file shadow' WHEN 3 THEN 'Network scan detected' WHEN 4 THEN 'Container escape via chroot'
  WHEN 5 THEN 'Write below root' ELSE 'Run shell untrusted' END"""
PRIORITY = "CASE k % 6 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Error' WHEN 2 THEN 'Warning' WHEN 3 THEN 'Notice' WHEN 4 THEN 'Emergency' ELSE 'Debug' END"

# --- DuckDB ------------------------------------------------------------------------------------
SIG = """sig AS (SELECT event_id, ts, user_id, event_type, value, concat('ns-', user_id % 10) AS ns,
  concat('pod-', user_id) AS pod, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
LOGS = f"""{SIG}, logs AS (SELECT *, {LINE} AS line, {JOB} AS job, {EVENT_CLASS} AS event_class,
  concat(ns, '/', pod, '/', event_type) AS stream_id FROM sig)"""
INC = """inc AS (SELECT o_orderkey AS incident_id, o_orderdate AS opened_at,
  o_orderdate + INTERVAL 1 SECOND * (o_custkey % 86400) AS closed_at, concat('ns-', o_custkey % 20) AS ns, o_totalprice,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'escalated' ELSE 'open' END AS status,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SOC' WHEN o_orderpriority = '3-MEDIUM' THEN 'SRE' ELSE 'MIXED' END AS domain,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'escalate' WHEN '2-HIGH' THEN 'known' WHEN '3-MEDIUM' THEN 'structured'
       WHEN '5-LOW' THEN 'novel' ELSE 'probe_timeout' END AS route FROM orders)"""
REW = """rew AS (SELECT l_orderkey AS incident_id, l_linenumber, concat('rule-', l_suppkey % 25) AS rule_name,
  CASE l_returnflag WHEN 'R' THEN 'resolved' WHEN 'A' THEN 'escalated' ELSE 'failed' END AS outcome,
  l_shipdate AS recorded_at, l_quantity AS duration_s, l_linestatus, l_partkey FROM lineitem)"""


# --- Spark -------------------------------------------------------------------------------------
def signals(t: Tables, events: DataFrame | None = None) -> DataFrame:
    return (t.events if events is None else events).select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.concat(F.lit("ns-"), (F.col("user_id") % 10).cast("string")).alias("ns"),
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("pod"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def logs(t: Tables) -> DataFrame:
    s = signals(t)
    return s.select(
        "*",
        F.expr(LINE).alias("line"),
        F.expr(JOB).alias("job"),
        F.expr(EVENT_CLASS).alias("event_class"),
        F.concat_ws("/", "ns", "pod", "event_type").alias("stream_id"),
    ).withColumn(
        "labels",
        F.create_map(
            F.lit("job"), F.col("job"), F.lit("event_class"), F.col("event_class"),
            F.lit("namespace"), F.col("ns"), F.lit("pod"), F.col("pod"),
        ),
    )


def incidents(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    return t.orders.select(
        F.col("o_orderkey").alias("incident_id"),
        F.col("o_orderdate").alias("opened_at"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_custkey") % 86400).cast("decimal(18,6)"))).alias("closed_at"),
        F.concat(F.lit("ns-"), (F.col("o_custkey") % 20).cast("string")).alias("ns"),
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "escalated")
        .otherwise("open").alias("status"),
        F.when(p.isin("1-URGENT", "2-HIGH"), "SOC").when(p == "3-MEDIUM", "SRE").otherwise("MIXED").alias("domain"),
        F.when(p == "1-URGENT", "escalate").when(p == "2-HIGH", "known").when(p == "3-MEDIUM", "structured")
        .when(p == "5-LOW", "novel").otherwise("probe_timeout").alias("route"),
    )


def rewards(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("incident_id"),
        "l_linenumber",
        F.concat(F.lit("rule-"), (F.col("l_suppkey") % 25).cast("string")).alias("rule_name"),
        F.when(F.col("l_returnflag") == "R", "resolved").when(F.col("l_returnflag") == "A", "escalated")
        .otherwise("failed").alias("outcome"),
        F.col("l_shipdate").alias("recorded_at"),
        F.col("l_quantity").alias("duration_s"),
        "l_linestatus",
        "l_partkey",
    )
