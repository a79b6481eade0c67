"""Normalisers for webhook payloads and raw log envelopes. Work on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.operators.shape import fold_severity

ALERT_SCHEMA = (
    "alerts ARRAY<STRUCT<status STRING, labels MAP<STRING,STRING>, annotations MAP<STRING,STRING>>>"
)

DEPLOY_SCHEMA = """
    involvedObject STRUCT<kind STRING, name STRING, namespace STRING>,
    severity STRING, message STRING, reportingController STRING, metadata STRUCT<revision STRING>,
    object_kind STRING, ref STRING, user_name STRING,
    commits ARRAY<STRUCT<id STRING, message STRING>>,
    repository STRUCT<name STRING>, user STRUCT<name STRING>,
    object_attributes STRUCT<state STRING, title STRING, last_commit STRUCT<id STRING>>
"""


def explode_alerts(bodies: DataFrame, body: str = "alert_body") -> DataFrame:
    """One row per alert of each JSON body; bodies that do not parse yield no row."""
    keep = [c for c in bodies.columns if c != body]
    parsed = bodies.select(*keep, F.from_json(body, ALERT_SCHEMA).alias("_p"))
    alerts = parsed.select(*keep, F.posexplode("_p.alerts").alias("alert_no", "_a"))
    lab = F.col("_a.labels")
    return alerts.select(
        *keep,
        "alert_no",
        F.coalesce("_a.status", F.lit("")).alias("status"),
        F.coalesce(lab["alertname"], F.lit("unknown")).alias("alertname"),
        F.coalesce(lab["namespace"], F.lit("")).alias("ns"),
        lab["source"].alias("source"),
        F.col("_a.labels").alias("labels"),
        F.col("_a.annotations").alias("annotations"),
    )


def _shaped_deploys(payloads: DataFrame, body: str) -> DataFrame:
    # inline() parses each body once; selecting fields of from_json would parse once per field
    d = payloads.select("*", F.inline(F.array(F.from_json(body, DEPLOY_SCHEMA))))
    reconciler = F.col("involvedObject").isNotNull()
    push = F.col("object_kind") == "push"
    merge = F.col("object_kind") == "merge_request"
    none = F.lit("")

    def pick(a, b, c):
        return F.when(reconciler, F.coalesce(a, none)).when(push, F.coalesce(b, none)).when(merge, F.coalesce(c, none))

    commit = F.try_element_at("commits", F.lit(1))
    branch = F.replace(F.coalesce("ref", none), F.lit("refs/heads/"), none)
    kind = F.lower(F.coalesce("involvedObject.kind", none))
    repo = F.col("repository.name")
    return d.select(
        *payloads.columns,
        F.when(reconciler, "flux").when(push | merge, "gitlab").alias("source"),
        pick(F.when(kind != "", kind).otherwise("flux"), F.lit("push"), F.lit("merge_request")).alias("event_type"),
        pick(F.col("involvedObject.namespace"), none, none).alias("namespace"),
        pick(F.col("involvedObject.name"), repo, repo).alias("resource_name"),
        pick(
            F.col("metadata.revision"), F.left(commit["id"], F.lit(12)), F.left("object_attributes.last_commit.id", F.lit(12))
        ).alias("revision"),
        pick(
            F.when(F.col("severity") == "error", "failed").otherwise("succeeded"), F.lit("pushed"), F.col("object_attributes.state")
        ).alias("status"),
        pick(F.coalesce("reportingController", F.lit("flux")), F.col("user_name"), F.col("user.name")).alias("actor"),
        pick(
            F.col("message"),
            F.concat(F.lit("branch="), branch, F.lit(" "), F.coalesce(commit["message"], none)),
            F.col("object_attributes.title"),
        ).alias("message"),
    )


def normalize_deploys(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Reconciler events, pushes and merge requests in one schema; unknown shapes are left out."""
    return _shaped_deploys(payloads, body).filter(F.col("source").isNotNull()).drop(body)


def parsed_logs(raw: DataFrame, line: str = "raw") -> DataFrame:
    """raw with _json, its line parsed once, and _fault: null, `empty`, or `json` if the line begins as an object but is none."""
    c = F.col(line)
    begins = F.ltrim(c).startswith("{")
    read = raw.withColumn("_json", F.when(begins, F.try_parse_json(c)))
    return read.withColumn("_fault", F.when(c.isNull() | (F.trim(c) == ""), "empty").when(begins & F.col("_json").isNull(), "json"))


def normalize_logs(raw: DataFrame, line: str = "raw", conn_host: str = "conn_host") -> DataFrame:
    """Container, Windows-channel, audit and syslog lines in one schema with a log_source column."""
    return _normalized(parsed_logs(raw, line).drop("_fault"), raw.columns, line, conn_host)


def _normalized(raw: DataFrame, columns: list[str], line: str, conn_host: str) -> DataFrame:
    c = F.col(line)
    is_json = F.ltrim(c).startswith("{")

    def get(path: str):
        return F.try_variant_get("_json", path, "string")

    windows = get("$.Channel").isNotNull()
    audit = get("$.verb").isNotNull()
    container = get("$.log").isNotNull()
    app = F.when(~is_json, F.nullif(F.regexp_extract(c, fv.SYSLOG_APP_PATTERN, 1), F.lit("")))
    text = F.when(~is_json, F.nullif(F.regexp_extract(c, fv.SYSLOG_APP_PATTERN, 2), F.lit("")))
    host = F.coalesce(F.nullif(get("$.Computer"), F.lit("")), F.nullif(get("$.hostname"), F.lit("")), F.col(conn_host))
    keep = [x for x in columns if x not in (line, conn_host)]
    return raw.select(
        *keep,
        F.when(windows, "windows").when(audit, "k8s-audit").when(container, "container")
        .when(is_json, "otlp").otherwise("syslog").alias("log_source"),
        host.alias("host"),
        F.when(windows, get("$.Channel")).when(audit, F.lit("kube-apiserver"))
        .when(container, get("$.stream")).otherwise(app).alias("app"),
        fold_severity(F.coalesce(get("$.severity"), F.lit("informational"))).alias("level"),
        F.coalesce(get("$.Message"), get("$.log"), F.when(is_json, c), text, c).alias("message"),
    )


def split_logs(raw: DataFrame, line: str = "raw", conn_host: str = "conn_host") -> tuple[DataFrame, DataFrame]:
    """The normalised rows, and the rows that can't be (quarantine): all columns of raw and their fault."""
    read = parsed_logs(raw, line)
    good = _normalized(read.filter("_fault IS NULL").drop("_fault"), raw.columns, line, conn_host)
    return good, read.filter("_fault IS NOT NULL").select(*raw.columns, F.col("_fault").alias("fault"))
