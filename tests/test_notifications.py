"""Notices against a machine that takes every single alert."""

import datetime as dt
import random

import pytest

from opsignal.operators import correlate, routing

T0 = dt.datetime(2024, 1, 1)


def replay(alerts, wait, interval, repeat):
    alerts, out, k = sorted(alerts), [], 0
    flush = None
    told, pending, sent = set(), set(), None
    while True:
        if flush is None:
            if k == len(alerts):
                return out
            flush, told, sent = alerts[k][0] + wait, set(), None
        while k < len(alerts) and alerts[k][0] <= flush:
            pending.add(alerts[k][1])
            k += 1
        if not pending:
            flush = None
            continue
        new = pending - told
        if new or flush - sent >= repeat:
            out.append((flush, len(new), len(pending)))
            sent = flush
        told |= pending
        pending = set()
        flush += interval


@pytest.mark.parametrize("wait, interval, repeat", [(10, 300, 1800), (300, 60, 600), (30, 30, 30)])
def test_notices_equal_the_replay(spark, wait, interval, repeat):
    rng = random.Random(wait)
    groups = {"busy": [(rng.randrange(40_000), f"f{rng.randrange(4)}") for _ in range(3000)], "calm": [(rng.randrange(40_000), f"f{rng.randrange(3)}") for _ in range(40)], None: [(5, "x")]}
    rows = [(g, f, T0 + dt.timedelta(seconds=s), wait, interval, repeat) for g, alerts in groups.items() for s, f in alerts]
    df = spark.createDataFrame(rows, "g string, fp string, ts timestamp_ntz, w int, i int, r int")
    got = {}
    for r in routing.notifications(df, ["g"], "fp", "ts", "w", "i", "r").collect():
        got.setdefault(r["g"], []).append(((r["sent_at"] - T0).total_seconds(), r["n_new"], r["n_alerts"]))
    # a name that is null and one that is empty are told apart by nothing but the name column
    assert {g: sorted(v) for g, v in got.items()} == {g: replay(a, wait, interval, repeat) for g, a in groups.items()}


def test_two_batches_of_pairs_equal_one(spark):
    rng = random.Random(2)
    hits = [(f"a{rng.randrange(2)}", "b", rng.choice([-60, 0, 60]), rng.random(), f"inc{k % 30}", T0 + dt.timedelta(minutes=k)) for k in range(80)]
    schema = "a string, b string, lag_s int, r double, incident string, ts timestamp_ntz"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    one = correlate.merge_hits(None, frame(hits), [], "incident", "ts")
    two = correlate.merge_hits(correlate.merge_hits(None, frame(hits[:50]), [], "incident", "ts"), frame(hits[30:]), [], "incident", "ts")
    again = correlate.merge_hits(two, frame(hits[:50]), [], "incident", "ts")
    key = lambda df: sorted((r["a"], r["b"], r["lag_s"], r["incident_count"], round(r["avg_r"], 9), r["latest_r"], r["last_seen"]) for r in correlate.best_pairs(df, [], "ts").collect())
    assert key(one) == key(two) == key(again)
    latest = max((h for h in hits if h[:3] == ("a0", "b", 0)), key=lambda h: h[5])
    assert next(k for k in key(one) if k[:3] == ("a0", "b", 0))[5:] == (latest[3], latest[5])
