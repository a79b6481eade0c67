"""Log shaping: matchers, drops, classification and enrichment of single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.text import all_of, any_of, full_match, label, label_matches, last_match
from opsignal.functions.timecells import as_col


def match_labels(df: DataFrame, labels: str, matchers: list[tuple[str, str, str]]) -> DataFrame:
    """Keep rows whose labels satisfy every (name, operator, operand)."""
    return df.filter(all_of([label_matches(label(labels, n), op, v) for n, op, v in matchers]))


def filter_lines(df: DataFrame, line: str, contains=(), regex=(), not_contains=(), not_regex=()) -> DataFrame:
    """AND-chained substring and regular-expression line filters."""
    c = F.col(line)
    conds = [c.contains(x) for x in contains] + [c.rlike(x) for x in regex]
    conds += [~c.contains(x) for x in not_contains] + [~c.rlike(x) for x in not_regex]
    return df.filter(all_of(conds))


def like_filter(c: Column | str, any_like=(), none_like=()) -> Column:
    """Disjunction of LIKE patterns and a conjunction of NOT LIKE patterns."""
    col = as_col(c)
    return any_of([col.like(p) for p in any_like]) & all_of([~col.like(p) for p in none_like])


def json_field(line: Column | str, key: str) -> Column:
    """Top-level field of a JSON line; null for lines that are not JSON objects."""
    c = as_col(line)
    return F.when(F.ltrim(c).startswith("{"), F.get_json_object(c, f"$.{key}"))


def drop_matching(df: DataFrame, line: str, patterns: list[str]) -> DataFrame:
    return df.filter(~any_of([F.col(line).rlike(p) for p in patterns]))


def drop_debug(df: DataFrame, line: str = "line") -> DataFrame:
    return drop_matching(df, line, fv.DROP_LEVEL_PATTERNS)


def drop_noise(df: DataFrame, line: str = "line") -> DataFrame:
    return drop_matching(df, line, fv.DROP_AUDIT_PATTERNS + fv.DROP_EXEC_PATTERNS)


def classify_tier(
    df: DataFrame,
    ns: str,
    job: str,
    priority: str,
    line: str,
    auth_namespaces: list[str],
    infrastructure_namespaces: list[str] = fv.INFRASTRUCTURE_NAMESPACES,
    security_namespaces: list[str] = fv.SECURITY_NAMESPACES,
) -> DataFrame:
    """Add event_class and tier. Runtime and audit jobs have their own rules; the rest go by namespace."""
    n = F.col(ns)
    runtime, audit = F.col(job) == "runtime", F.col(job) == "audit"
    event_class = last_match(
        [
            (n.isin(auth_namespaces), "auth"),
            (n.isin(infrastructure_namespaces), "infrastructure"),
            (n.isin(security_namespaces), "runtime-security"),
            (runtime, "runtime-security"),
            (audit, "k8s-audit"),
        ],
        "application",
    )
    by_priority = last_match([(F.col(priority).isin(p), t) for p, t in fv.PRIORITY_TIERS], None)
    by_audit = last_match([(F.col(line).rlike(fv.SENSITIVE_AUDIT_PATTERN), "high")], "medium")
    by_ns = last_match([(n.isin(security_namespaces), "high")], "low")
    return df.withColumn("event_class", event_class).withColumn(
        "tier", F.when(runtime, by_priority).when(audit, by_audit).otherwise(by_ns)
    )


def hint_lookup(df: DataFrame, rule: str) -> DataFrame:
    """Add remediation_hint and runbook_ref from patterns on the rule name."""
    return df.withColumn(
        "remediation_hint", last_match([(full_match(rule, p), h) for p, h in fv.REMEDIATION_HINTS], None)
    ).withColumn("runbook_ref", last_match([(full_match(rule, p), h) for p, h in fv.RUNBOOK_REFS], None))


def extract_technique(c: Column | str) -> Column:
    return F.regexp_extract(as_col(c), fv.TECHNIQUE_PATTERN, 1)


def fold_severity(c: Column | str) -> Column:
    col = as_col(c)
    return last_match([(full_match(col, p), v) for p, v in fv.SEVERITY_FOLDS], col)


def infer_platform(signals: Column, patterns: Column, rules: Column, services: Column) -> Column:
    """windows, kubernetes or linux from string arrays; the first match wins."""

    def has(arr: Column, *needles: str, lower: bool = False) -> Column:
        return F.exists(arr, lambda s: any_of([(F.lower(s) if lower else s).contains(x) for x in needles]))

    return (
        F.when(has(signals, "windows", lower=True) | has(patterns, "windows", lower=True), "windows")
        .when(has(patterns, "EventID"), "windows")
        .when(has(patterns, "CrashLoop", "OOMKill", "Pod") | has(rules, "CrashLoop", "OOMKill", "Pod"), "kubernetes")
        .when(has(services, "/"), "kubernetes")
        .otherwise("linux")
    )


def attack_enrich(incidents: DataFrame, key: str, rules: str, index: DataFrame, techniques: DataFrame) -> DataFrame:
    """Technique context of each incident: rule ids -> technique ids -> metadata, distinct, in first-seen order.

    index(rule_id, tid), techniques(tid, name, tactic). The list per incident is bounded by the
    number of techniques.
    """
    found = (
        incidents.select(key, F.posexplode(rules).alias("_pos", "rule_id"))
        .join(index, "rule_id")
        .withColumn("tid", F.upper("tid"))
        .groupBy(key, "tid")
        .agg(F.min("_pos").alias("_pos"))
        .join(techniques.withColumn("tid", F.upper("tid")), "tid")
    )
    text = F.concat(F.col("tid"), F.lit(" "), F.col("name"), F.lit(" ["), F.col("tactic"), F.lit("]"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "tid", text.alias("text"))))
    return found.groupBy(key).agg(
        F.count("*").alias("n_techniques"),
        F.array_join(F.transform(ordered, lambda x: x["text"]), "; ").alias("context"),
    )
