"""Detection: rules as data compiled to one expression, deduplication, correlations, responses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.text import all_of, any_of, event_hash, first_technique_tag
from opsignal.functions.timecells import cell, cell_time, timespan_seconds
from opsignal.operators.ranges import range_sums, step_reduce


# --- rules -> columns ----------------------------------------------------------------------------
def field_condition(field: str, wanted, fields: dict[str, Column]) -> Column:
    """`Name`, `Name|contains`, `Name|startswith` or `Name|endswith` against one value or a list (OR).

    Text compares without case; numbers compare as numbers.
    """
    name, _, modifier = field.partition("|")
    col = fields[name]
    values = wanted if isinstance(wanted, list) else [wanted]

    def one(v) -> Column:
        if not modifier and not isinstance(v, str):
            return F.coalesce(col.try_cast("double") == F.lit(float(v)), F.lit(False))
        text, v = F.coalesce(F.lower(col.cast("string")), F.lit("")), str(v).lower()
        if modifier == "contains":
            return (text != "") if v == "*" else text.contains(v)
        if modifier == "startswith":
            return text.startswith(v)
        if modifier == "endswith":
            return text.endswith(v)
        return text == v

    return any_of([one(v) for v in values])


def rule_condition(rule: dict, fields: dict[str, Column]) -> Column:
    """rule = {"selections": {name: {field: values}}, "condition": name | ("and"|"or", ...) | ("not", x)}."""
    selections = {
        name: all_of([field_condition(f, v, fields) for f, v in body.items()]) for name, body in rule["selections"].items()
    }

    def build(node) -> Column:
        if isinstance(node, str):
            return selections[node]
        op, *args = node
        if op == "not":
            return ~build(args[0])
        parts = [build(a) for a in args]
        return all_of(parts) if op == "and" else any_of(parts)

    return build(rule["condition"])


def match_rules(df: DataFrame, rules: list[dict], keep: list[str]) -> DataFrame:
    """Every rule over one scan: an array of rule structs per row, nulls dropped, exploded.

    Each rule has id, title, level, tags and a boolean Column under "where".
    """
    hits = [
        F.when(
            r["where"],
            F.struct(
                F.lit(r["id"]).alias("rule_id"), F.lit(r["title"]).alias("rule_title"), F.lit(r["level"]).alias("rule_level"),
                F.array(*[F.lit(t) for t in r["tags"]]).cast("array<string>").alias("rule_tags"),
            ),
        )
        for r in rules
    ]
    found = df.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("_r")).select(*keep, "_r.*")
    return found.withColumn("mitre", first_technique_tag("rule_tags"))


def count_alerts(logs: DataFrame, alerts: list[tuple], labels: str, line: str, ts: str, step_s: int = 60) -> DataFrame:
    """alert, by (map of the labels counted by), t, n: the alerts whose count over their trailing range is passed at a step that saw a line.

    alerts: as fixed_values.COUNT_ALERTS. All are looked for in one scan; what they find is counted per alert, labels and step
    before anything is ordered, and every range is a difference of running counts. A label that a line lacks is empty.
    """
    lab = lambda n: F.coalesce(F.try_element_at(F.col(labels), F.lit(n)), F.lit(""))
    hits = []
    for name, wanted, unwanted, needles, by, _, _ in alerts:
        where = all_of([*(lab(n).isin(v) for n, v in wanted.items()), *(~lab(n).startswith(v) for n, v in unwanted.items()), *(F.col(line).contains(x) for x in needles)])
        key = F.to_json(F.struct(*[lab(n).alias(n) for n in by])) if by else F.lit("{}")
        hits.append(F.when(where, F.struct(F.lit(name).alias("alert"), key.alias("by"))))
    found = logs.select(ts, F.explode(F.array_compact(F.array(*hits))).alias("_h")).select(ts, "_h.*")
    steps = step_reduce(found, ["alert", "by"], ts, step_s, [F.count("*").alias("n")])
    ranges = F.create_map(*[F.lit(x) for a in alerts for x in (a[0], a[5])])
    limits = F.create_map(*[F.lit(x) for a in alerts for x in (a[0], a[6])])
    sums = range_sums(steps, ["alert", "by"], ["n"], sorted({a[5] for a in alerts}), step_s)
    passed = sums.filter((F.col("win") == ranges[F.col("alert")]) & (F.col("n") > limits[F.col("alert")]))
    return passed.select("alert", F.from_json("by", "map<string,string>").alias("by"), cell_time("step", step_s).alias("t"), "n")


def sql_rule(spark: SparkSession, text: str, logs: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """A rule given as SQL over {logs} with the named parameters :start_ns and :end_ns."""
    return spark.sql(text, args={"start_ns": start_ns, "end_ns": end_ns}, logs=logs)


def dedup_matches(matches: DataFrame, stored: DataFrame | None, order: list[str]) -> DataFrame:
    """First match per (rule, namespace, minute), without those already stored.

    The first row comes from an aggregate, so copies of one hash are reduced before the shuffle.
    """
    cols = [c for c in matches.columns if c != "event_hash"]
    hashed = matches.withColumn("event_hash", event_hash("rule_id", "ns", "ts"))
    first = hashed.groupBy("event_hash").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_m"))
    first = first.select("event_hash", "_m.*")
    return first if stored is None else first.join(stored.select("event_hash"), "event_hash", "left_anti")


# --- correlations --------------------------------------------------------------------------------
_OPS = {
    "gte": lambda c, n: c >= n, "gt": lambda c, n: c > n, "lte": lambda c, n: c <= n, "lt": lambda c, n: c < n, "eq": lambda c, n: c == n,
}


def _condition(col: Column, condition: dict) -> Column:
    ops = [op for op in _OPS if op in condition]
    if len(ops) != 1:
        raise ValueError(f"a correlation needs exactly one of {', '.join(_OPS)}: {condition}")
    return _OPS[ops[0]](col, F.lit(int(condition[ops[0]])))


def _fine(span_s: int, cycle_s: int) -> int:
    """Width of the cells that both scan ends and scan starts fall on."""
    return math.gcd(span_s, cycle_s)


def _scan_windows(cells: DataFrame, span_s: int, cycle_s: int) -> DataFrame:
    """Copy each fine cell's row to the scans whose window [scan end - span, scan end) holds the whole cell.

    A span shorter than the cycle leaves cells that no scan sees.
    """
    fine = _fine(span_s, cycle_s)
    first = F.ceil((F.col("_c") + 1) * F.lit(fine) / F.lit(cycle_s)).cast("bigint")
    last = F.floor((F.col("_c") * F.lit(fine) + F.lit(span_s)) / F.lit(cycle_s)).cast("bigint")
    return cells.withColumn("_w", F.explode(F.when(first <= last, F.sequence(first, last))))


def _referenced(matches: DataFrame, rules: list[str]) -> DataFrame:
    return matches.filter(F.col("rule_id").isin(rules))


def event_count(matches: DataFrame, corr: dict, cycle_s: int = 300) -> DataFrame:
    """Matches per rule and group inside the time span, at every scan.

    Matches are counted per scan cycle first; only the counts are copied to the overlapping spans.
    """
    keys, span = corr.get("group_by", []), timespan_seconds(corr.get("timespan", fv.CORRELATION_TIMESPAN))
    cells = _referenced(matches, corr["rules"]).groupBy("rule_id", *keys, cell("ts", _fine(span, cycle_s)).alias("_c")).agg(
        F.count("*").alias("_n"), F.min("ts").alias("_lo"), F.max("ts").alias("_hi")
    )
    out = _scan_windows(cells, span, cycle_s).groupBy("rule_id", *keys, "_w").agg(
        F.sum("_n").alias("cnt"), F.min("_lo").alias("first_seen"), F.max("_hi").alias("last_seen")
    )
    return out.filter(_condition(F.col("cnt"), corr["condition"])).withColumn("scan_end", cell_time("_w", cycle_s)).drop("_w")


def value_count(matches: DataFrame, corr: dict, cycle_s: int = 300) -> DataFrame:
    """Distinct values of a field per rule and group inside the time span, at every scan."""
    keys, span = corr.get("group_by", []), timespan_seconds(corr.get("timespan", fv.CORRELATION_TIMESPAN))
    field = corr["condition"].get("field", "log_string")
    cells = _referenced(matches, corr["rules"]).groupBy("rule_id", *keys, F.col(field).alias("_v"), cell("ts", _fine(span, cycle_s)).alias("_c")).agg(
        F.min("ts").alias("_lo"), F.max("ts").alias("_hi")
    )
    per_value = _scan_windows(cells, span, cycle_s).groupBy("rule_id", *keys, "_w", "_v").agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    out = per_value.groupBy("rule_id", *keys, "_w").agg(
        F.count("_v").alias("ucount"), F.min("_lo").alias("first_seen"), F.max("_hi").alias("last_seen")
    )
    return out.filter(_condition(F.col("ucount"), corr["condition"])).withColumn("scan_end", cell_time("_w", cycle_s)).drop("_w")


def temporal(matches: DataFrame, corr: dict, cycle_s: int = 300) -> DataFrame:
    """Groups in which all the referenced rules were seen inside the time span."""
    keys, span = corr.get("group_by", []), timespan_seconds(corr.get("timespan", fv.CORRELATION_TIMESPAN))
    cells = _referenced(matches, corr["rules"]).groupBy("rule_id", *keys, cell("ts", _fine(span, cycle_s)).alias("_c")).agg(
        F.min("ts").alias("_lo"), F.max("ts").alias("_hi")
    )
    per_rule = _scan_windows(cells, span, cycle_s).groupBy(*keys, "_w", "rule_id").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    out = per_rule.groupBy(*keys, "_w").agg(
        F.count("*").alias("rule_count"), F.min("_lo").alias("first_seen"), F.max("_hi").alias("last_seen")
    )
    return out.filter(F.col("rule_count") >= len(corr["rules"])).withColumn("scan_end", cell_time("_w", cycle_s)).drop("_w")


def correlation_matches(found: DataFrame, rule: dict) -> DataFrame:
    """Correlation results as match rows, with the result as a JSON summary."""
    slug = F.concat(F.lit("corr_"), F.regexp_replace(F.lower(F.lit(rule["title"])), "[^a-z0-9_]", "_"))
    ns = F.col("ns") if "ns" in found.columns else F.lit("")
    rows = found.select(
        slug.alias("rule_id"), F.lit(rule["title"]).alias("rule_title"), F.lit(rule.get("level", "medium")).alias("rule_level"),
        ns.alias("ns"), F.col("last_seen").alias("ts"), F.to_json(F.struct(*found.columns)).alias("log_string"),
    )
    return rows.withColumn("event_hash", event_hash("rule_id", "ns", "ts"))


# --- signatures ----------------------------------------------------------------------------------
def signature_condition(text: Column, spec: dict) -> Column:
    """any / all substrings (case kept), all_nocase / any_nocase, any_regex."""
    conds = []
    either = [text.contains(s) for s in spec.get("any", [])]
    either += [F.lower(text).contains(s.lower()) for s in spec.get("any_nocase", [])]
    either += [text.rlike(p) for p in spec.get("any_regex", [])]
    if either:
        conds.append(any_of(either))
    conds += [text.contains(s) for s in spec.get("all", [])]
    conds += [F.lower(text).contains(s.lower()) for s in spec.get("all_nocase", [])]
    return all_of(conds)


def scan_signatures(df: DataFrame, text: str, keep: list[str], signatures: dict[str, dict] = fv.SIGNATURES) -> DataFrame:
    """All signatures over the whole text in one pass; one row per (row, signature)."""
    hits = [F.when(signature_condition(F.col(text), spec), F.lit(name)) for name, spec in signatures.items()]
    return df.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("signature"))


def signature_names(df: DataFrame, keys: list[str], line: str, field: str) -> DataFrame:
    """Distinct signature names per key, from lines whose JSON field reads 'Name /path'."""
    name = F.split_part(F.trim(F.get_json_object(line, f"$.{field}")), F.lit(" "), F.lit(1))
    rows = df.select(*keys, F.when(F.ltrim(F.col(line)).startswith("{"), name).alias("_name"))
    return rows.filter(F.col("_name") != "").groupBy(*keys).agg(F.array_sort(F.collect_set("_name")).alias("signatures"))


# --- responses and exceptions --------------------------------------------------------------------
def response_lookup(df: DataFrame, rule: str, actions=fv.RESPONSE_ACTIONS) -> DataFrame:
    """Action list of each detected rule, one row per action in order; a decision only.

    The action table is fixed and small, so it becomes a map literal instead of a join.
    """
    table = F.create_map(*[x for name, acts in actions for x in (F.lit(name.lower()), F.array(*[F.lit(a) for a in acts]))])
    return df.select("*", F.posexplode_outer(F.try_element_at(table, F.lower(rule))).alias("action_no", "action"))


def apply_exceptions(df: DataFrame, rule: str, container: str, path: str, exceptions=fv.RULE_EXCEPTIONS) -> DataFrame:
    """Drop matches covered by an exception: (rule, container or any, path prefix)."""
    covered = any_of([
        (F.col(rule) == r) & F.coalesce(F.col(path), F.lit("")).startswith(p) & (F.lit(True) if c is None else F.col(container).eqNullSafe(c))
        for r, c, p in exceptions
    ])
    return df.filter(~covered)

