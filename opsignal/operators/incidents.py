"""Incident assembly and lifecycle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.text import any_of
from opsignal.functions.timecells import SECOND, cell, epoch_us, from_epoch_us, seconds_between
from opsignal.operators.joins import asof_join, exists_between


def merge_arrays(df: DataFrame, keys: list[str], cols: list[str], out: str) -> DataFrame:
    """Distinct union of array columns over all rows of a key; partial aggregation keeps distinct items only."""
    items = df.select(*keys, F.explode(F.concat(*cols)).alias("_item"))
    return items.groupBy(*keys).agg(F.array_sort(F.collect_set("_item")).alias(out))


# --- classification ------------------------------------------------------------------------------
def domain_rank(domain: Column) -> Column:
    return F.when(domain == "SOC", 2).when(domain == "SRE", 1).otherwise(0)


def domain_name(rank: Column) -> Column:
    return F.when(rank == 2, "SOC").when(rank == 1, "SRE").otherwise("MIXED")


def merge_domain(df: DataFrame, keys: list[str], domain: str) -> DataFrame:
    """SOC over SRE over MIXED; merging never downgrades."""
    return df.groupBy(*keys).agg(domain_name(F.max(domain_rank(F.col(domain)))).alias(domain))


def fast_classify(
    df: DataFrame, rules: str, match_ids: str, patterns: str, anomalies: str, source: str
) -> DataFrame:
    """Domain and route from the signal arrays; patterns are structs with is_novel and security_correlated."""
    critical = [r.lower() for r in fv.CRITICAL_RULES]
    has_rule, has_match = F.size(rules) > 0, F.size(match_ids) > 0
    critical_rule = F.exists(rules, lambda r: F.lower(r).isin(critical))
    novel = F.exists(patterns, lambda p: p["is_novel"])
    novel_near = F.exists(patterns, lambda p: p["is_novel"] & p["security_correlated"])
    out = lambda d, r: F.struct(F.lit(d).alias("domain"), F.lit(r).alias("route"))
    verdict = (
        F.when(critical_rule, out("SOC", "known"))
        .when(has_match, out("SOC", "structured"))
        .when(novel_near, out("MIXED", "escalate"))
        .when(novel & has_rule, out("SOC", "novel"))
        .when(novel, out("MIXED", "novel"))
        .when((F.size(anomalies) > 0) & ~has_rule, out("SRE", "structured"))
        .when(has_rule, out("SOC", "structured"))
        .otherwise(out("MIXED", "structured"))
    )
    rows = df.withColumn("_v", verdict)
    # Infrastructure alerts without any security signal are reliability work, not noise.
    promote = (
        (F.col("_v.domain") == "MIXED") & (F.col("_v.route") == "structured") & ~has_rule & ~has_match
        & F.coalesce(F.col(source).isin("sre", "observability"), F.lit(False))
    )
    return rows.withColumns(
        {"domain": F.when(promote, "SRE").otherwise(F.col("_v.domain")), "route": F.col("_v.route")}
    ).drop("_v")


# --- sessions and assembly -----------------------------------------------------------------------
INFRA = ("sre", "observability")
ISLAND_CELLS = 2000
RUN = ["ns", "_era", "rule", "_c", "_seg"]


def _keyed(alerts: DataFrame, ns: str, rule: str, ts: str, ident: str, gap_s: int) -> DataFrame:
    """Alerts with the run that they belong to: (ns, _era, rule, _c, _seg); all alerts of a run share an incident.

    Inside a cell as wide as the gap an incident stays open, so a rule's alerts of one cell are one run. Which incident is the
    newest can change there only at the first alert of some rule, so alerts without a rule are cut at those.
    """
    order = F.col(ident) if ident in alerts.columns else F.xxhash64("alertname", "source")
    rows = alerts.select(
        F.coalesce(F.col(ns), F.lit("")).alias("ns"), F.coalesce(F.col(rule), F.lit("")).alias("rule"), F.col(ts).alias("_ts"),
        F.struct(F.col(ts).alias("ts"), order.alias("id")).alias("_at"), "alertname", "source",
        F.col("_era") if "_era" in alerts.columns else F.lit(0).cast("bigint").alias("_era"),
    ).withColumn("_c", cell("_ts", gap_s))
    ruled, bare = rows.filter("rule <> ''"), rows.filter("rule = ''")
    firsts = ruled.groupBy("ns", "_era", "_c", "rule").agg(F.min("_at").alias("_first")).groupBy("ns", "_era", "_c").agg(F.collect_list("_first").alias("_firsts"))
    before = F.size(F.filter("_firsts", lambda f: f < F.col("_at")))
    cut = bare.join(firsts, ["ns", "_era", "_c"], "left").withColumn("_seg", F.when(F.col("_firsts").isNull(), 0).otherwise(before)).drop("_firsts")
    return ruled.withColumn("_seg", F.lit(0)).unionByName(cut)


def _fold(gap_s: int):
    """A namespace's runs in time order: each joins the newest open incident of its rule (of any, without a rule) or opens one."""

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("lo", "ascending"), ("lo_id", "ascending")])
        live: dict[str, list] = {}  # of each rule the one incident that may be open: [opened, id, last alert]
        opened, ident, of, now = [], [], [], None
        for era, rule, lo, lo_id, hi in zip(*(t[c].to_pylist() for c in ("_era", "rule", "lo", "lo_id", "hi")), strict=True):
            live = {r: i for r, i in live.items() if lo - i[2] < gap_s * SECOND} if era == now else {}
            now = era
            name = rule if rule else max(live, key=lambda r: live[r][:2], default="")
            if name not in live:
                live[name] = [lo, lo_id, hi]
            live[name][2] = max(live[name][2], hi)
            opened.append(live[name][0])
            ident.append(live[name][1])
            of.append(name)
        return t.append_column("opened", pa.array(opened, pa.int64())).append_column("opened_id", pa.array(ident, pa.int64())).append_column("of", pa.array(of, pa.string()))

    return place


def placed_runs(keyed: DataFrame, gap_s: int) -> DataFrame:
    """One row per run of _keyed() with its counts and its incident: incident_id, of (the incident's rule, or none).

    A namespace falls into islands where no alert comes for the gap; whole islands that start within ISLAND_CELLS cells are folded
    together, in one task. An island has at most a run per rule and two per opening in each cell, however many alerts there are.
    """
    infra = F.coalesce(F.col("source").isin(*INFRA), F.lit(False))
    runs = keyed.groupBy(*RUN).agg(
        epoch_us(F.min("_ts")).alias("lo"), F.min("_at")["id"].cast("bigint").alias("lo_id"), epoch_us(F.max("_ts")).alias("hi"),
        F.count("*").alias("n"), F.count_if(infra).alias("infra"), F.min(F.struct("_at", "alertname", "source")).alias("first"),
    )
    cells = runs.groupBy("ns", "_era", "_c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    o = Window.partitionBy("ns").orderBy("_c", "_era")
    # where nothing is open any more: after a gap, or a closing
    starts = F.coalesce((F.col("lo") - F.lag("hi").over(o) >= gap_s * SECOND) | (F.col("_era") != F.lag("_era").over(o)), F.lit(True))
    numbered = cells.select("ns", "_era", "_c", F.when(starts, F.row_number().over(o)).alias("start"))
    dealt = numbered.select("ns", "_era", "_c", F.floor(F.max("start").over(o) / ISLAND_CELLS).alias("islands"))
    bare = runs.join(dealt, ["ns", "_era", "_c"]).select(*RUN, "islands", "lo", "lo_id", "hi")
    schema = bare.schema.simpleString()[len("struct<"):-1] + ",opened:bigint,opened_id:bigint,of:string"
    where = bare.groupBy("ns", "islands").applyInArrow(_fold(gap_s), schema)
    ident = F.md5(F.concat_ws("|", "ns", "of", F.col("opened").cast("string")))
    return runs.join(where.select(*RUN, "of", "opened", "opened_id", ident.alias("incident_id")), RUN)


def _sessions(placed: DataFrame) -> DataFrame:
    infra_bare = F.when(F.col("rule") == "", F.col("infra")).otherwise(0)
    out = placed.groupBy("incident_id", "ns", F.col("of").alias("rule")).agg(
        from_epoch_us(F.min("opened")).alias("opened_at"), from_epoch_us(F.max("hi")).alias("window_end"), F.sum("n").alias("n_alerts"),
        F.sum(F.when(F.col("rule") != "", F.col("n")).otherwise(0)).alias("_ruled"), F.sum(infra_bare).alias("_infra"), F.min("first").alias("_f"),
    )
    # only alerts that are merged into an open incident upgrade it, the first one doesn't
    first_infra = F.when(F.col("rule") == "", F.coalesce(F.col("_f.source").isin(*INFRA), F.lit(False)).cast("int")).otherwise(0)
    ruled = F.col("_ruled") > F.when(F.col("rule") != "", 1).otherwise(0)
    rank = F.when(ruled, 2).when(F.col("_infra") > first_infra, 1).otherwise(0)
    return out.select(
        "incident_id", "ns", "rule", "opened_at", "window_end", "n_alerts", rank.alias("alert_rank"),
        F.col("_f.alertname").alias("alertname"), F.col("_f.source").alias("source"),
    )


def incident_sessions(
    alerts: DataFrame, ns: str = "ns", rule: str = "rule", ts: str = "ts", gap_s: int = fv.DEDUP_GAP_S, ident: str = "event_id"
) -> DataFrame:
    """Incidents of alerts (ns, rule, ts, event_id, alertname, source).

    An alert with a rule joins the open incident of its namespace and rule; one without a rule joins the newest open
    incident of its namespace, whatever its rule; otherwise it opens one. An incident is open while its last alert is
    less than the gap ago. Alerts of one instant come in the order of event_id (a hash of name and source, if there is
    none). No namespace is a namespace of its own.
    """
    return _sessions(placed_runs(_keyed(alerts, ns, rule, ts, ident, gap_s), gap_s))


def incident_lifecycle(alerts: DataFrame, resolved: DataFrame, gap_s: int = fv.DEDUP_GAP_S) -> DataFrame:
    """incident_sessions() in which a resolved alert (ns, ts) closes all open incidents of its namespace: what comes later opens anew.

    closed_at, status: of the close, if there was one. A resolved alert comes before the alerts of its instant.
    """
    ends = resolved.select(F.coalesce("ns", F.lit("")).alias("ns"), F.col("ts").alias("_end"), epoch_us("ts").alias("_era"))
    named = alerts.withColumn("ns", F.coalesce("ns", F.lit("")))
    dated = asof_join(named, ends, ["ns"], "ts", "_end", ["_era"], inclusive=True).withColumn("_era", F.coalesce("_era", F.lit(-(2**63))))
    sessions = incident_sessions(dated, gap_s=gap_s)
    return close_incidents(sessions, ends.select("ns", "_end"), "ns", "opened_at", "_end")


def spans(times: DataFrame, key: str, width_s: int) -> DataFrame:
    """key, start, end: the union of [t - width, t) over rows (key, lo, hi), whose times between lo and hi lie less than the width apart."""
    o = Window.partitionBy(key).orderBy("lo")
    before = F.max("hi").over(o.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("lo") - width_s * SECOND > before, 1).otherwise(0)
    marked = times.select(key, "lo", "hi", apart.alias("_new")).select(key, "lo", "hi", F.sum("_new").over(o).alias("_i"))
    return marked.groupBy(key, "_i").agg((F.min("lo") - width_s * SECOND).alias("start"), F.max("hi").alias("end")).drop("_i")


def window_totals(windows: DataFrame, signals: DataFrame, key: str, step_s: int) -> DataFrame:
    """key, kind, name, total, peak, is_novel, security_correlated of the signals in each window (key, ns, start, end).

    signals(ns, ts, kind, name, weight, is_novel, security_correlated) are summed per (ns, kind, name, cell) first; a window takes its
    whole cells from these sums and single rows only from the two cells at its edges.
    """
    step = F.lit(step_s * SECOND)
    sums = [F.sum("weight").alias("total"), F.max("weight").alias("peak"), F.max("is_novel").alias("is_novel"), F.max("security_correlated").alias("security_correlated")]
    celled = signals.withColumn("_c", cell("ts", step_s))
    per_cell = celled.groupBy("ns", "kind", "name", "_c").agg(*sums)
    first, last = F.ceil(F.col("start") / step).cast("bigint"), F.floor(F.col("end") / step).cast("bigint")
    whole = windows.filter(first < last).select(key, "ns", F.explode(F.sequence(first, last - 1)).alias("_c")).join(per_cell, ["ns", "_c"])
    edge = F.array_distinct(F.array(F.floor(F.col("start") / step), last))
    cut = F.filter(edge.cast("array<bigint>"), lambda c: (c < first) | (c >= last))
    at = epoch_us("ts")
    single = windows.select(key, "ns", "start", "end", F.explode(cut).alias("_c")).join(celled, ["ns", "_c"]).filter((at >= F.col("start")) & (at < F.col("end")))
    rows = whole.select(key, "kind", "name", "total", "peak", "is_novel", "security_correlated").unionByName(
        single.groupBy(key, "kind", "name").agg(*sums)
    )
    return rows.groupBy(key, "kind", "name").agg(
        F.sum("total").alias("total"), F.max("peak").alias("peak"), F.max("is_novel").alias("is_novel"), F.max("security_correlated").alias("security_correlated")
    )


def names_in_spans(found: DataFrame, signals: DataFrame, key: str, cell_s: int) -> DataFrame:
    """key, name: which names come in the spans (key, ns, start, end), none shorter than a cell.

    Of each (ns, name, cell) only the first and last time are kept: a span that holds the cell in part reaches over one of
    its ends, so these two decide.
    """
    step = F.lit(cell_s * SECOND)
    at = epoch_us("ts")
    seen = signals.groupBy("ns", "name", cell("ts", cell_s).alias("_c")).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    reach = F.sequence(F.floor(F.col("start") / step).cast("bigint"), F.floor((F.col("end") - 1) / step).cast("bigint"))
    dealt = found.select(key, "ns", "start", "end", F.explode(reach).alias("_c"))
    return dealt.join(seen, ["ns", "_c"]).filter((F.col("hi") >= F.col("start")) & (F.col("lo") < F.col("end"))).select(key, "name").distinct()


def _everywhere(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows, and those that a window without a namespace may hold once more with no namespace; windows(ns, start, end)."""
    day = 86400
    span = F.sequence(F.floor(F.col("start") / F.lit(day * SECOND)), F.floor(F.col("end") / F.lit(day * SECOND)))
    days = windows.filter("ns = ''").select(F.explode(span).alias("_day")).distinct()
    again = rows.filter("ns <> ''").join(days, cell("ts", day) == F.col("_day"), "left_semi")
    return rows.unionByName(again.withColumn("ns", F.lit("")))


def assemble_incidents(alerts: DataFrame, signals: DataFrame, window_s: int = fv.INCIDENT_WINDOW_S, gap_s: int = fv.DEDUP_GAP_S) -> DataFrame:
    """One row per incident with the signals of its alerts' windows, classified.

    signals(ns, ts, kind in match|pattern|anomaly, name, weight, is_novel, security_correlated). Patterns, anomalies and the
    route come from the window before the first alert; match_ids are those of the windows before all its alerts, and a merged
    alert that has a rule or brings a match makes the incident SOC. Anomalies count in every namespace; an incident without a
    namespace has the matches and patterns of all. The arrays hold distinct names.
    """
    keyed = _keyed(alerts, "ns", "rule", "ts", "event_id", gap_s)
    placed = placed_runs(keyed, gap_s).persist()  # a row per run; the fold feeds five joins
    sessions = _sessions(placed)
    step_s = max(1, window_s // 10)

    start = epoch_us("opened_at")
    opened = sessions.select("incident_id", "ns", (start - window_s * SECOND).alias("start"), start.alias("end"))
    plain = signals.select(F.coalesce("ns", F.lit("")).alias("ns"), "ts", "kind", "name", "weight", "is_novel", "security_correlated")
    local, shared = plain.filter("kind <> 'anomaly'"), plain.filter("kind = 'anomaly'").withColumn("ns", F.lit("*"))
    named = window_totals(opened, _everywhere(local, opened), "incident_id", step_s).unionByName(
        window_totals(opened.withColumn("ns", F.lit("*")), shared, "incident_id", step_s)
    )
    pattern = F.struct(F.col("name").alias("template"), F.col("total").alias("samples_count"), "is_novel", "security_correlated")
    anomaly = F.struct(F.col("name").alias("metric"), F.col("peak").alias("deviation_ratio"))
    gathered = named.groupBy("incident_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "match", F.col("name")))).alias("first_ids"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "pattern", pattern))).alias("patterns"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "anomaly", anomaly))).alias("anomalies"),
    )
    times = keyed.groupBy(*RUN, cell("_ts", window_s).alias("_w")).agg(epoch_us(F.min("_ts")).alias("lo"), epoch_us(F.max("_ts")).alias("hi"))
    times = times.join(placed.select(*RUN, "incident_id"), RUN)
    union = spans(times.select("incident_id", "lo", "hi"), "incident_id", window_s).join(sessions.select("incident_id", "ns"), "incident_id")
    matches = _everywhere(local.filter("kind = 'match'").select("ns", "ts", "name"), union)
    all_ids = names_in_spans(union, matches, "incident_id", step_s).groupBy("incident_id").agg(F.array_sort(F.collect_list("name")).alias("match_ids"))

    rows = sessions.join(gathered, "incident_id", "left").join(all_ids, "incident_id", "left")
    kinds = {c: gathered.schema[c].dataType for c in ("first_ids", "patterns", "anomalies")} | {"match_ids": all_ids.schema["match_ids"].dataType}
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in kinds.items()})
    named_alert = F.array(F.struct(
        F.col("alertname").alias("template"), F.lit(1.0).alias("samples_count"), F.lit(False).alias("is_novel"),
        F.lit(False).alias("security_correlated"),
    )).cast(kinds["patterns"])
    rows = rows.withColumns({
        "patterns": F.when((F.size("patterns") == 0) & F.col("alertname").isNotNull(), named_alert).otherwise(F.col("patterns")),
        "rules": F.when(F.col("rule") != "", F.array("rule")).otherwise(F.array().cast("array<string>")),
    })
    done = fast_classify(rows, "rules", "first_ids", "patterns", "anomalies", "source")
    merged = F.when(F.size("match_ids") > 0, 2).otherwise(F.col("alert_rank"))
    return done.withColumn("domain", domain_name(F.greatest(domain_rank(F.col("domain")), merged))).drop("alert_rank", "first_ids")


# --- lifecycle -----------------------------------------------------------------------------------
def close_incidents(incidents: DataFrame, resolved: DataFrame, ns: str, opened: str, ts: str) -> DataFrame:
    """Close each incident at the next resolved alert of its namespace ('' closes those without one)."""
    at = resolved.select(ns, ts).withColumn("closed_at", F.col(ts))
    out = asof_join(incidents, at, [ns], opened, ts, ["closed_at"], direction="forward")
    return out.withColumn("status", F.when(F.col("closed_at").isNotNull(), "resolved").otherwise("open"))


def stale_incidents(incidents: DataFrame, as_of, max_age_s: int | None = None) -> DataFrame:
    """Update rows for incidents stuck in work for longer than remediation and validation may take."""
    age = max_age_s or fv.REMEDIATION_TIMEOUT_S + fv.VALIDATION_TIMEOUT_S + fv.STALE_GRACE_S
    stuck = incidents.filter(
        F.col("status").isin("in_progress", "validating") & (seconds_between("opened_at", F.lit(as_of)) > age)
    )
    return stuck.select(
        "incident_id", F.lit("resolved").alias("status"), F.lit("auto-resolved").alias("outcome"),
        F.lit(as_of).cast("timestamp_ntz").alias("closed_at"),
    )


def resume_open(incidents: DataFrame, as_of, max_age_s: int = fv.RESUME_MAX_AGE_S) -> DataFrame:
    age = seconds_between("opened_at", F.lit(as_of))
    return incidents.filter(
        F.col("closed_at").isNull() & F.col("status").isin("validating", "remediating") & (age >= 0) & (age < max_age_s)
    )


def open_counts(incidents: DataFrame, keys: list[str]) -> DataFrame:
    def n(cond):
        return F.count_if(cond)

    is_open = F.col("status").isin(fv.OPEN_STATUSES)
    return incidents.groupBy(*keys).agg(
        n(is_open).alias("open_total"), n(is_open & (F.col("domain") == "SOC")).alias("open_soc"),
        n(is_open & (F.col("domain") == "SRE")).alias("open_sre"), n(is_open & (F.col("route") == "escalate")).alias("open_escalate"),
        n(F.col("status") == "escalated").alias("escalated"),
    )


def clear_streaks(
    incidents: DataFrame, signals: DataFrame, key: str, ns: str, start: str, ts: str, poll_s: int = fv.VALIDATION_POLL_S,
    timeout_s: int = fv.VALIDATION_TIMEOUT_S, need: int = fv.CLEAR_STREAK,
) -> DataFrame:
    """Resolved at the first poll that ends `need` clean polls in a row, else escalated at the timeout.

    A signal at s makes the poll dirty whose preceding interval holds it: poll ceil((s - start) / poll), for s in (start, start + timeout].
    Of the signals of a namespace and a slice as long as a poll only the first and the last are kept: all between them lie
    in the polls of these two. So an incident meets timeout/poll + 1 rows however many signals there are.
    """
    last, poll = timeout_s // poll_s, F.lit(poll_s * SECOND)
    at = epoch_us(ts)
    slices = signals.groupBy(F.col(ns), cell(ts, poll_s).alias("_c")).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    begin = epoch_us(start)
    reach = F.sequence(F.floor(begin / poll).cast("bigint"), F.floor((begin + timeout_s * SECOND) / poll).cast("bigint"))
    met = incidents.select(key, ns, begin.alias("_s"), F.explode(reach).alias("_c")).join(slices, [ns, "_c"])
    number = lambda c: F.ceil((F.col(c) - F.col("_s")) / poll).cast("int")
    polls = met.select(key, F.explode(F.array_distinct(F.array(number("_lo"), number("_hi")))).alias("_p")).filter(F.col("_p").between(1, last))
    dirty = polls.groupBy(key).agg(F.collect_set("_p").alias("_dirty"))
    rows = incidents.join(dirty, key, "left")
    spoiled = F.coalesce("_dirty", F.array().cast("array<int>"))
    ends = F.filter(
        F.sequence(F.lit(need), F.lit(last)), lambda i: ~F.exists(spoiled, lambda d: (d > i - need) & (d <= i))
    )
    first = F.try_element_at(ends, F.lit(1))
    return rows.withColumn("_poll", first).select(
        *incidents.columns,
        F.when(F.col("_poll").isNotNull(), "resolved").otherwise("escalated").alias("outcome"),
        F.coalesce("_poll", F.lit(last)).alias("polls"),
        F.size(spoiled).alias("dirty_polls"),
    )


def heartbeat_gaps(df: DataFrame, keys: list[str], ts: str, gap_s: int = 900) -> DataFrame:
    """Silences longer than the gap. Beats inside one cell as wide as the gap have none between them,
    so only the first and last beat of each cell are ordered."""
    cells = df.groupBy(*keys, cell(ts, gap_s).alias("_c")).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    o = Window.partitionBy(*keys).orderBy("_c")
    rows = cells.select(*keys, F.lag("_hi").over(o).alias("last_seen"), F.col("_lo").alias("next_seen"))
    silent = seconds_between("last_seen", "next_seen")
    return rows.filter(silent > gap_s).withColumn("silent_s", F.floor(silent).cast("bigint"))


def freshness(tables: dict[str, tuple[DataFrame, str, int]], as_of) -> DataFrame:
    """Newest row of each (frame, time column, allowed lag) against the allowed lag."""
    parts = [
        df.agg(F.max(ts).alias("newest")).select(F.lit(name).alias("source_table"), "newest", F.lit(lag).alias("allowed_s"))
        for name, (df, ts, lag) in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lag_s = F.floor(seconds_between("newest", F.lit(as_of))).cast("bigint")
    return out.withColumn("lag_s", lag_s).withColumn("is_stale", F.col("newest").isNull() | (F.col("lag_s") > F.col("allowed_s")))


def breaker_open(failures: DataFrame, keys: list[str], ts: str, unique: str, more_than: int = 3, within_s: int = 3600) -> DataFrame:
    """Failures at which more than `more_than` failures lie in the trailing interval.

    True where the failure `more_than` places back is recent enough. Rows are ordered per (key, chunk
    of time); each row is also copied to the next chunk, as its look-back.
    """
    own = cell(ts, within_s)
    rows = failures.select(*keys, unique, ts, own.alias("_own"), F.explode(F.sequence(own, own + 1)).alias("_chunk"))
    o = Window.partitionBy(*keys, "_chunk").orderBy(ts, unique)
    back = F.lag(ts, more_than).over(o)
    rows = rows.withColumn("_back", back).filter((F.col("_own") == F.col("_chunk")) & F.col("_back").isNotNull())
    return rows.filter(epoch_us(ts) - epoch_us("_back") < within_s * SECOND).select(*keys, unique, ts)


# --- decision ------------------------------------------------------------------------------------
def select_rule(
    incidents: DataFrame, deploys: DataFrame, runbooks: DataFrame, rates: DataFrame, recent_s: int = 1800,
    pods: DataFrame | None = None, events: DataFrame | None = None,
) -> DataFrame:
    """Which response rule fits an incident; a decision only, nothing is executed.

    incidents(incident_id, ns, domain, opened_at, rules, templates, replicas), deploys(ns, deployed_at),
    runbooks(domain, template, created_at), rates(rule_name, rate), pods(ns, pod, reason, seen_at): waiting containers, events(ns, reason,
    message, seen_at). In a crash loop a sentinel pod that waits in one, or else an event of a failing probe, of the last recent_s
    seconds chooses the rule.
    """
    t, r = F.col("templates"), F.col("rules")

    def text(*needles: str, lower: bool = False) -> Column:
        return F.exists(t, lambda x: any_of([(F.lower(x) if lower else x).contains(n) for n in needles]))

    rows = exists_between(incidents, deploys, ["ns"], "opened_at", "deployed_at", -recent_s, 0, "_deployed")
    no_pods = incidents.select("ns", F.col("opened_at").alias("seen_at")).limit(0)
    waiting = no_pods if pods is None else pods.filter((F.col("reason") == "CrashLoopBackOff") & F.lower("pod").contains("sentinel")).select("ns", "seen_at")
    told = F.col("reason").isin(fv.PROBE_EVENT_REASONS) & any_of([F.lower("message").contains(m) for m in fv.PROBE_EVENT_MESSAGES])
    probes = no_pods if events is None else events.filter(told).select("ns", "seen_at")
    rows = exists_between(rows, waiting, ["ns"], "opened_at", "seen_at", -recent_s, 0, "_sentinel")
    rows = exists_between(rows, probes, ["ns"], "opened_at", "seen_at", -recent_s, 0, "_probe")
    after_deploy = text("CrashLoop", "ImagePullBackOff", "OOMKill") | text("probe", lower=True)
    chosen = (
        F.when(after_deploy & F.col("_deployed"), "flux_rollback")
        .when(F.exists(r, lambda x: F.lower(x).contains("probe") | F.lower(x).contains("timeout")), "probe_timeout")
        .when(text("OOMKill"), F.when(F.col("replicas") <= 1, "upsize").otherwise("oom_killed"))
        .when(text("CrashLoop"), F.when(F.col("_sentinel"), "redis_sentinel_heal").when(F.col("_probe"), "probe_timeout").otherwise("crashloop_config"))
        .when(text("ImagePullBackOff"), "image_pull_backoff")
        .when(text("probe", "timeout", lower=True), "probe_timeout")
        .when(
            text("cnpg", lower=True)
            | F.exists(t, lambda x: F.lower(x).contains("postgres") & F.lower(x).contains("not ready")),
            "cnpg_failover",
        )
        .when(text("sentinel", lower=True), "redis_sentinel_heal")
    )
    rows = rows.withColumn("rule_name", chosen).withColumn("_template", F.try_element_at(t, F.lit(1)))
    # A learned runbook for the same domain and first template wins over a chosen rule.
    learned = runbooks.groupBy("domain", F.col("template").alias("_template")).agg(F.min("created_at").alias("_since"))
    rows = rows.join(learned, ["domain", "_template"], "left")
    has_runbook = F.col("_since").isNotNull() & (F.col("_since") <= F.col("opened_at"))
    rows = rows.withColumn("rule_name", F.when(F.col("rule_name").isNotNull() & has_runbook, fv.LEARNED_RULE).otherwise(F.col("rule_name")))
    rows = rows.join(rates.select("rule_name", "rate"), "rule_name", "left")
    low = F.coalesce(F.col("rate") < fv.LOW_SUCCESS_RATE, F.lit(False))
    return rows.select(
        *incidents.columns, F.when(low, fv.DEFAULT_RULE).otherwise(F.col("rule_name")).alias("selected_rule")
    )
