"""Keyed state with event-time timers: incidents of a namespace, validation of incidents, known patterns.

Rows wait in the state until the watermark has passed them and are then taken in event time, so the result doesn't depend on how
the input is cut into batches, nor on its order within the lateness; a row that is given twice is one row. The state lives
in RocksDB: use_keyed_state() before the query starts. A restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from opsignal import fixed_values as fv
from opsignal.functions.timecells import MINUTE, SECOND, epoch_us
from opsignal.operators.incidents import INFRA
from opsignal.streaming.windows import timed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WORKED_ON = ("in_progress", "validating")


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _after(us: int, step_ms: int = 1) -> int:
    """A timer in ms, on a multiple of the step, that expires when the watermark has passed the instant."""
    return (us // 1000 // step_ms + 1) * step_ms


# --- incidents -----------------------------------------------------------------------------------
CHANGES = (
    "ns string, incident_id string, rule string, change string, at_us long, opened_us long, window_end_us long, n_alerts long, alert_rank int, "
    "status string, outcome string, alertname string, source string"
)
ORDER = {"resolved": 0, "alert": 1, "status": 2}


class Incidents(StatefulProcessor):
    """The incidents of one namespace. Alerts open or extend them, a resolved alert closes all, a status change goes to the
    newest one that is open; one that is worked on for too long is closed when its time is up, without any row."""

    def __init__(self, gap_s: int, age_s: int, keep_s: int):
        self.gap, self.age, self.keep = gap_s * SECOND, age_s * SECOND, keep_s * SECOND

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long, kind string, id long", "rule string, alertname string, source string, status string")
        self.open = handle.getMapState(
            "open", "incident_id string",
            "rule string, opened long, oid long, hi long, n long, rank int, status string, alertname string, source string",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.ts_us, r.kind, r.id), (r.rule, r.alertname, r.source, r.status))
            self.handle.registerTimer(_after(r.ts_us, 1000 * MINUTE))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ns, now = key[0], timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((k for k in self.waiting.keys() if k[0] < now), key=lambda k: (k[0], ORDER[k[1]], k[2]))
        incidents = {k[0]: dict(zip(("rule", "opened", "oid", "hi", "n", "rank", "status", "alertname", "source"), v)) for k, v in self.open.iterator()}
        before = {i: dict(x) for i, x in incidents.items()}
        out = []
        for k in due:
            out += self._deadlines(ns, incidents, k[0])
            out += self._event(ns, incidents, k, self.waiting.getValue(k))
            self.waiting.removeKey(k)
        out += self._deadlines(ns, incidents, now - 1)
        for i in before.keys() - incidents.keys():
            self.open.removeKey((i,))
        for i, x in incidents.items():
            if x != before.get(i):
                self.open.updateValue((i,), tuple(x.values()))
                deadline = self._deadline(x)
                if deadline is not None:
                    self.handle.registerTimer(_after(deadline))
        return iter(out)

    def _deadline(self, x: dict) -> int:
        return min(x["opened"] + self.age + 1 if x["status"] in WORKED_ON else x["hi"] + self.keep, x["hi"] + self.keep)

    def _row(self, ns: str, i: str, x: dict, change: str, at: int, status: str | None = None, outcome: str | None = None) -> Row:
        return Row(
            ns=ns, incident_id=i, rule=x["rule"], change=change, at_us=at, opened_us=x["opened"], window_end_us=x["hi"], n_alerts=x["n"],
            alert_rank=x["rank"], status=status or x["status"], outcome=outcome, alertname=x["alertname"], source=x["source"],
        )

    def _deadlines(self, ns: str, incidents: dict, upto: int) -> Iterator[Row]:
        for i, x in sorted(incidents.items(), key=lambda p: (self._deadline(p[1]), p[0])):
            at = self._deadline(x)
            if at <= upto:
                stale = x["status"] in WORKED_ON and at == x["opened"] + self.age + 1
                del incidents[i]
                yield self._row(ns, i, x, "stale", at, "resolved", "auto-resolved") if stale else self._row(ns, i, x, "forgotten", at)

    def _event(self, ns: str, incidents: dict, key: tuple, value: tuple) -> Iterator[Row]:
        (ts, kind, ident), (rule, alertname, source, status) = key, value
        if kind == "resolved":
            for i, x in sorted(incidents.items()):
                yield self._row(ns, i, x, "resolved", ts, "resolved", "resolved")
            incidents.clear()
        elif kind == "status":
            newest = max(incidents, key=lambda i: (incidents[i]["opened"], incidents[i]["oid"]), default=None)
            if newest is not None:
                incidents[newest]["status"] = status
                yield self._row(ns, newest, incidents[newest], "status", ts)
        else:
            live = [i for i, x in incidents.items() if ts - x["hi"] < self.gap and (not rule or x["rule"] == rule)]
            name = max(live, key=lambda i: (incidents[i]["opened"], incidents[i]["oid"]), default=None)
            change = "merged"
            if name is None:
                name, change = hashlib.md5(f"{ns}|{rule}|{ts}".encode()).hexdigest(), "opened"
                incidents[name] = {"rule": rule, "opened": ts, "oid": ident, "hi": ts, "n": 0, "rank": 0, "status": "open", "alertname": alertname, "source": source}
            x = incidents[name]
            x["hi"], x["n"] = ts, x["n"] + 1
            if change == "merged":
                x["rank"] = max(x["rank"], 2 if rule else 1 if source in INFRA else 0)
            yield self._row(ns, name, x, change, ts)


def incident_changes(
    events: DataFrame, late: str, gap_s: int = fv.DEDUP_GAP_S,
    age_s: int = fv.REMEDIATION_TIMEOUT_S + fv.VALIDATION_TIMEOUT_S + fv.STALE_GRACE_S, keep_s: int = 30 * 86400,
) -> DataFrame:
    """A row per change of an incident, in event time: opened, merged, status, resolved, stale (closed when its time is up), forgotten.

    events(ns, ts, kind in alert|resolved|status, id, rule, alertname, source, status), streaming, id distinct among the rows of one
    namespace, instant and kind. The last row of an incident is its state; after a restart the open ones are still there. An
    incident without any close leaves the state keep_s after its last alert (forgotten). Rows of one instant: resolved
    before alerts before status changes, then by id. Rows behind the watermark are dropped.
    """
    empty = F.lit("")
    rows = timed(events, "ts", late).select(
        F.coalesce("ns", empty).alias("ns"), "ts", epoch_us("ts").alias("ts_us"), "kind", F.col("id").cast("bigint").alias("id"),
        F.coalesce("rule", empty).alias("rule"), "alertname", "source", "status",
    )
    return rows.groupBy("ns").transformWithState(Incidents(gap_s, age_s, keep_s), CHANGES, "append", "eventTime")


# --- validation ----------------------------------------------------------------------------------
class Streaks(StatefulProcessor):
    """Polls the incidents of one namespace: each poll is a timer, whether or not a row comes."""

    def __init__(self, poll_s: int, timeout_s: int, need: int):
        self.poll, self.last, self.need = poll_s * SECOND, timeout_s // poll_s, need

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "incident_id string", "start long, poll int, streak int, dirty int")
        # of each slice as long as a poll the first and the last signal: a poll's span ends inside at most two of them
        self.seen = handle.getMapState("seen", "slice long", "lo long, hi long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            if r.incident_id is None:
                k = (r.ts_us // self.poll,)
                lo, hi = self.seen.getValue(k) or (r.ts_us, r.ts_us)
                self.seen.updateValue(k, (min(lo, r.ts_us), max(hi, r.ts_us)))
                self.handle.registerTimer(_after(r.ts_us + 2 * self.poll))
            elif not self.pending.containsKey((r.incident_id,)):
                self.pending.updateValue((r.incident_id,), (r.ts_us, 1, 0, 0))
                self.handle.registerTimer(_after(r.ts_us + self.poll))
        return iter(())

    def _is_dirty(self, start: int, end: int) -> bool:
        """Whether a signal came in (start, end]."""
        spans = (self.seen.getValue((k,)) for k in range(start // self.poll, end // self.poll + 1))
        return any(s is not None and s[1] > start and s[0] <= end for s in spans)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, out, first = timerValues.getCurrentWatermarkInMs() * 1000, [], None
        for (ident,), (start, poll, streak, dirty) in sorted(self.pending.iterator()):
            outcome = None
            while outcome is None and start + poll * self.poll < now:
                at = start + poll * self.poll
                bad = self._is_dirty(at - self.poll, at)
                streak, dirty = 0 if bad else streak + 1, dirty + bad
                outcome = "resolved" if streak >= self.need else "escalated" if poll >= self.last else None
                poll += 1
            if outcome is not None:
                self.pending.removeKey((ident,))
                out.append(Row(ns=key[0], incident_id=ident, outcome=outcome, polls=poll - 1, dirty_polls=int(dirty)))
                continue
            self.pending.updateValue((ident,), (start, poll, streak, int(dirty)))
            self.handle.registerTimer(_after(start + poll * self.poll))
            since = start + (poll - 1) * self.poll
            first = since if first is None else min(first, since)
        keep = min(now, now if first is None else first) // self.poll - 1
        for k in [k for k in self.seen.keys() if k[0] < keep]:
            self.seen.removeKey(k)
        return iter(out)


def clear_streaks(
    incidents: DataFrame, signals: DataFrame, late: str, poll_s: int = fv.VALIDATION_POLL_S, timeout_s: int = fv.VALIDATION_TIMEOUT_S,
    need: int = fv.CLEAR_STREAK,
) -> DataFrame:
    """ns, incident_id, outcome, polls, dirty_polls of each incident(ns, incident_id, ts), as soon as it is settled.

    Resolved at the poll that ends `need` clean polls in a row, escalated at the timeout; signals(ns, ts). dirty_polls counts
    up to the last poll. An incident that is given again while it is pending is one; signals of a namespace take two numbers
    per poll's length in the state, until no pending poll can see them.
    """
    columns = ["ns", "ts", "incident_id"]
    rows = timed(incidents.select(*columns), "ts", late).unionByName(
        timed(signals.select("ns", "ts", F.lit(None).cast(incidents.schema["incident_id"].dataType).alias("incident_id")), "ts", late)
    ).select(F.coalesce("ns", F.lit("")).alias("ns"), "ts", epoch_us("ts").alias("ts_us"), F.col("incident_id").cast("string").alias("incident_id"))
    out = "ns string, incident_id string, outcome string, polls int, dirty_polls int"
    return rows.groupBy("ns").transformWithState(Streaks(poll_s, timeout_s, need), out, "append", "eventTime")


# --- known patterns ------------------------------------------------------------------------------
class Known(StatefulProcessor):
    """When a pattern was first seen, and again after it had been away for longer than it is remembered."""

    def __init__(self, expire_s: int):
        self.expire = expire_s * SECOND

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long")
        self.waiting = handle.getMapState("waiting", "ts long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.ts_us,), (1,))
            self.handle.registerTimer(_after(r.ts_us, 1000 * MINUTE))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        last = self.last.get()[0] if self.last.exists() else None
        for (ts,) in sorted(k for k in self.waiting.keys() if k[0] < now):
            if last is None or ts - last > self.expire:
                out.append(Row(pattern_id=key[0], first_seen_us=ts))
            last = ts
            self.waiting.removeKey((ts,))
        if last is not None and last + self.expire < now:
            self.last.clear()
        elif last is not None:
            self.last.update((last,))
            self.handle.registerTimer(_after(last + self.expire))
        return iter(out)


def novel_patterns(sightings: DataFrame, late: str, expire_s: int = 30 * 86400) -> DataFrame:
    """pattern_id, first_seen_us: a row when a pattern is seen that isn't known. sightings(pattern_id, ts), streaming.

    A pattern is known for expire_s after its last sighting; then its state goes. Sightings of one pattern within a second
    are one, so a frequent pattern has at most one number per second of lateness in the state.
    """
    rows = timed(sightings, "ts", late).select("pattern_id", "ts", (F.floor(epoch_us("ts") / SECOND) * SECOND).alias("ts_us"))
    return rows.groupBy("pattern_id").transformWithState(Known(expire_s), "pattern_id string, first_seen_us long", "append", "eventTime")
