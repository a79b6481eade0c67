"""Incident dedup and assembly against a replay, one alert after the other."""

import datetime as dt
import hashlib
import random

import pytest

from opsignal.operators import incidents

T0 = dt.datetime(2024, 1, 1)
ALERT = "event_id long, ns string, rule string, ts timestamp_ntz, alertname string, source string"
SIGNAL = "ns string, ts timestamp_ntz, kind string, name string, weight double, is_novel boolean, security_correlated boolean"
GAP, WINDOW = 1800, 600


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def us(t):
    return int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def replay(alerts, ends=()):
    """incident_id -> its alerts, by the rule: newest open incident of the namespace and, if the alert has one, of the rule."""
    opened = []
    for e in sorted([("alert", a) for a in alerts] + [("end", e) for e in ends], key=lambda x: (x[1][3 if x[0] == "alert" else 1], x[0] == "alert", x[1][0] if x[0] == "alert" else 0)):
        if e[0] == "end":
            for i in opened:
                if i["ns"] == e[1][0] and i["closed"] is None:
                    i["closed"] = e[1][1]
            continue
        ident, ns, rule, ts, *_ = a = e[1]
        ns, rule = ns or "", rule or ""
        live = [i for i in opened if i["ns"] == ns and i["closed"] is None and (ts - i["end"]).total_seconds() < GAP and (not rule or i["rule"] == rule)]
        if not live:
            opened.append({"ns": ns, "rule": rule, "opened": ts, "oid": ident, "closed": None, "alerts": []})
            live = opened[-1:]
        best = max(live, key=lambda i: (i["opened"], i["oid"]))
        best["end"] = ts
        best["alerts"].append(a)
    return {hashlib.md5(f"{i['ns']}|{i['rule']}|{us(i['opened'])}".encode()).hexdigest(): i for i in opened}


@pytest.fixture
def alerts():
    rng = random.Random(9)
    rows, n = [], 0
    for ns, count, span in (("hot", 1500, 86_400 * 2), ("a", 200, 86_400), ("b", 60, 86_400), (None, 40, 86_400)):
        for _ in range(count):
            n += 1
            rows.append((n, ns, rng.choice([None, None, "", "r1", "r2", "r3"]), at(rng.randrange(span)), f"A{n % 3}", rng.choice(["sre", "probe", None])))
    rows += [(9000, "a", None, rows[1600][3], "tie", "sre"), (9001, "a", "r1", rows[1600][3], "tie", "sre")]
    rows += [(9100, "q", None, at(0), "A", None), (9101, "q", None, at(1500), "A", None)]
    return rows


def test_sessions_equal_the_replay(spark, alerts):
    want = {i: (x["ns"], x["rule"], x["opened"], x["end"], len(x["alerts"])) for i, x in replay(alerts).items()}
    got = incidents.incident_sessions(spark.createDataFrame(alerts, ALERT)).collect()
    assert {r["incident_id"]: (r["ns"], r["rule"], r["opened_at"], r["window_end"], r["n_alerts"]) for r in got} == want and len(got) == len(want)
    assert any(not a[2] for x in replay(alerts).values() if x["rule"] for a in x["alerts"])  # alerts without a rule have joined others


def test_lifecycle_equals_the_replay(spark, alerts):
    ends = [("hot", at(s)) for s in range(5000, 170_000, 7001)] + [("a", at(40_000))] + [("b", alerts[1750][3])]
    want = {i: (x["opened"], x["end"], len(x["alerts"]), x["closed"]) for i, x in replay(alerts, ends).items()}
    got = incidents.incident_lifecycle(spark.createDataFrame(alerts, ALERT), spark.createDataFrame(ends, "ns string, ts timestamp_ntz")).collect()
    assert {r["incident_id"]: (r["opened_at"], r["window_end"], r["n_alerts"], r["closed_at"]) for r in got} == want


def test_assembly_merges_the_matches_of_all_alerts(spark, alerts):
    rng = random.Random(4)
    signals = [(rng.choice(["hot", "a", "b", "c"]), at(rng.randrange(86_400)), rng.choice(["match", "pattern", "anomaly"]), f"n{rng.randrange(8)}", 1.0, False, False) for _ in range(900)]
    signals += [(ns, at(s), "match", "edge", 1.0, False, False) for ns in ("a", "b") for s in (0, 599, 600)]
    signals += [("q", at(1400), "match", "later", 1.0, False, False)]
    got = {r["incident_id"]: r for r in incidents.assemble_incidents(spark.createDataFrame(alerts, ALERT), spark.createDataFrame(signals, SIGNAL)).collect()}
    told = replay(alerts)
    assert set(got) == set(told)
    soc = 0
    for i, x in told.items():
        near = lambda t, s: dt.timedelta(0) < t - s[1] <= dt.timedelta(seconds=WINDOW)
        here = [s for s in signals if not x["ns"] or s[0] == x["ns"]]
        matches = sorted({s[3] for s in here if s[2] == "match" and any(near(a[3], s) for a in x["alerts"])})
        patterns = {}
        for s in here:
            if s[2] == "pattern" and near(x["opened"], s):
                patterns[s[3]] = patterns.get(s[3], 0) + 1
        anomalies = sorted({s[3] for s in signals if s[2] == "anomaly" and near(x["opened"], s)})
        r = got[i]
        assert r["match_ids"] == matches
        assert {p["template"]: p["samples_count"] for p in r["patterns"]} == (patterns or {x["alerts"][0][4]: 1})
        assert [a["metric"] for a in r["anomalies"]] == anomalies
        ruled = x["rule"] or any(a[2] for a in x["alerts"][1:])
        first = any(s[2] == "match" and near(x["opened"], s) for s in here)
        assert (r["domain"] == "SOC") == bool(matches or ruled)
        soc += bool(matches and not first and not ruled)
    assert soc  # a merged alert alone has made incidents SOC
