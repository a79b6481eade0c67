"""Alert routing, muting and repeat suppression."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.text import all_of, any_of, label, label_matches
from opsignal.functions.timecells import SECOND, as_col, epoch_us, from_epoch_us


def route_alerts(df: DataFrame, labels: str, ts: str, policies=fv.ROUTING_POLICIES, root=fv.ROOT_POLICY) -> DataFrame:
    """One row per receiver of each alert: the first matching policy and those before it that continue.

    An alert that no policy matches goes to the root policy. Policies are compiled into one array expression. Adds
    receiver, group_key, wait_s, interval_s, repeat_s and muted.
    """
    lab = F.col(labels)
    clock = F.date_format(ts, "HH:mm")

    def route(p: dict) -> Column:
        open_now = any_of([(clock >= a) & (clock < b) for a, b in p["open_times"]]) if "open_times" in p else F.lit(True)
        key = F.concat_ws("|", *[label(lab, g) for g in p["group_by"]])
        times = [F.lit(p[n]).alias(n) for n in ("wait_s", "interval_s", "repeat_s")]
        return F.struct(F.lit(p["receiver"]).alias("receiver"), key.alias("group_key"), *times, (~open_now).alias("muted"))

    stopped = matched = F.lit(False)
    out = []
    for p in policies:
        hit = all_of([label_matches(label(lab, n), op, v) for n, op, v in p["match"]])
        out.append(F.when(hit & ~stopped, route(p)))
        matched = matched | hit
        if not p.get("continue"):
            stopped = stopped | hit
    routed = F.array_compact(F.array(*out, F.when(~matched, route(root))))
    return df.withColumn("_p", F.explode(routed)).select(*df.columns, "_p.*")


def repeat_suppress(df: DataFrame, group: list[str], ts: str, repeat: Column | str, interval: Column | str) -> DataFrame:
    """Notification times of each group: the first alert, then whenever the repeat interval has passed.

    Groups are flushed at multiples of their interval (seconds, one value per group), so alerts are first reduced to
    distinct ticks. Which tick sends depends on the one sent before it: a fold over the ordered ticks of a group, at
    most time span / interval numbers however many alerts the group has.
    """
    width = as_col(interval).cast("bigint") * F.lit(SECOND)
    rows = df.select(*group, as_col(repeat).alias("_repeat"), as_col(interval).cast("bigint").alias("_interval"), F.ceil(epoch_us(ts) / width).cast("bigint").alias("_tick"))
    ticks = rows.groupBy(*group).agg(
        F.array_sort(F.collect_set("_tick")).alias("_ticks"), F.max("_repeat").alias("_repeat"), F.max("_interval").alias("_interval")
    )
    wait = F.ceil(F.col("_repeat") / F.col("_interval"))
    none = F.array().cast("array<bigint>")

    def step(sent: Column, tick: Column) -> Column:
        due = (F.size(sent) == 0) | (tick - F.try_element_at(sent, F.lit(-1)) >= wait)
        return F.when(due, F.concat(sent, F.array(tick))).otherwise(sent)

    sent = F.aggregate("_ticks", none, step)
    return ticks.select(*group, "_interval", F.explode(sent).alias("_t")).select(
        *group, from_epoch_us(F.col("_t") * F.col("_interval") * F.lit(SECOND)).alias("sent_at")
    )


NOTICE = "group_id string, sent_us long, n_new int, n_alerts int, reason string"


def _notify(t: pa.Table) -> pa.Table:
    """The notices of one group, from its alerts in time order, each of which stands for some of one fingerprint."""
    t = t.sort_by([("at", "ascending"), ("fingerprint", "ascending")])
    wait, interval, repeat = (t[c][0].as_py() * SECOND for c in ("_wait", "_interval", "_repeat"))
    out: list[tuple] = []
    flush, sent, told, pending = None, None, set(), set()  # next flush; last notice; fingerprints it told; those since the last flush
    alerts = list(zip(t["at"].to_pylist(), t["fingerprint"].to_pylist(), strict=True))
    k = 0
    while k < len(alerts) or pending:
        if flush is None:
            flush, sent, told = alerts[k][0] + wait, None, set()
        while k < len(alerts) and alerts[k][0] <= flush:
            pending.add(alerts[k][1])
            k += 1
        if not pending:  # nothing came since the last flush: the group is over
            flush = None
            continue
        new = pending - told
        if new or flush - sent >= repeat:
            out.append((t["group_id"][0].as_py(), flush, len(new), len(pending), "new" if new else "repeat"))
            sent = flush
        told |= pending
        pending = set()
        flush += interval
    names = ["group_id", "sent_us", "n_new", "n_alerts", "reason"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def notifications(df: DataFrame, group: list[str], fingerprint: str, ts: str, wait: str, interval: str, repeat: str) -> DataFrame:
    """group, sent_at, n_new, n_alerts, reason: when each group is notified, and of how many alerts.

    A group begins with an alert and is flushed wait seconds later, then at every interval; it ends at a flush before which
    nothing came. A flush with fingerprints that the group hasn't been told of is sent (new), one with known ones only if
    the last notice is repeat seconds old (repeat). wait, interval and repeat are columns with one value per group.

    Of the alerts of one fingerprint in a cell as long as the shorter of wait and interval only the first and the last
    can matter, so an alert that fires all the time has two rows per cell; a group's rows are then taken in one task.
    """
    name = F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group])
    width = F.least(F.col(wait), F.col(interval)).cast("bigint") * F.lit(SECOND)
    at = epoch_us(ts)
    times = [F.col(c).cast("bigint").alias(n) for c, n in ((wait, "_wait"), (interval, "_interval"), (repeat, "_repeat"))]
    rows = df.select(*group, name.alias("group_id"), F.col(fingerprint).cast("string").alias("fingerprint"), at.alias("at"), F.floor(at / width).alias("_c"), *times)
    ends = rows.groupBy(*group, "group_id", "fingerprint", "_c", "_wait", "_interval", "_repeat").agg(F.array_distinct(F.array(F.min("at"), F.max("at"))).alias("_at"))
    dealt = ends.select("group_id", "fingerprint", "_wait", "_interval", "_repeat", F.explode("_at").alias("at"))
    sent = dealt.groupBy("group_id").applyInArrow(lambda t: _notify(t), NOTICE)
    names = ends.select("group_id", *group).distinct()
    return sent.join(names, "group_id").select(*group, from_epoch_us(F.col("sent_us")).alias("sent_at"), "n_new", "n_alerts", "reason")
