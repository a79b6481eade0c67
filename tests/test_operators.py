import datetime as dt

import pytest

from opsignal import fixed_values as fv
from opsignal.functions.timecells import timespan_seconds, whole_cells
from opsignal.operators import detect, incidents, routing, shape, similar

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_timespan():
    assert [timespan_seconds(x) for x in ("30s", "15m", " 2 h ", "3d")] == [30, 900, 7200, 259200]
    for bad in ("", "m", "15", "15w", "1.5h", "-3m", "0m"):
        with pytest.raises(ValueError):
            timespan_seconds(bad)


def test_ranges_are_never_shortened():
    assert whole_cells(3600, 300) == 12
    for range_s, cell_s in ((60, 300), (420, 300), (0, 300)):
        with pytest.raises(ValueError):
            whole_cells(range_s, cell_s)


@pytest.mark.parametrize("span", ["1m", "5m", "7m", "24h"])
def test_event_count_equals_definition(spark, span):
    times = [0, 30, 61, 290, 300, 420, 421, 900, 3599]
    rows = spark.createDataFrame([("r", "a", at(s)) for s in times], "rule_id string, ns string, ts timestamp_ntz")
    corr = {"rules": ["r"], "group_by": ["ns"], "timespan": span, "condition": {"gte": 1}}
    got = {(r["scan_end"] - T0).total_seconds(): r["cnt"] for r in detect.event_count(rows, corr).collect()}
    size = timespan_seconds(span)
    want = {}
    for end in range(0, max(times) + size + 301, 300):
        n = sum(end - size <= s < end for s in times)
        if n:
            want[float(end)] = n
    assert got == want


def test_condition_needs_one_operator(spark):
    rows = spark.createDataFrame([("r", at(0))], "rule_id string, ts timestamp_ntz")
    for condition in ({}, {"gte": 1, "lt": 5}):
        with pytest.raises(ValueError):
            detect.event_count(rows, {"rules": ["r"], "condition": condition})


def routes(spark, labels):
    df = spark.createDataFrame([(1, at(0), labels)], "id long, ts timestamp_ntz, labels map<string,string>")
    return [(r["receiver"], r["group_key"], r["repeat_s"]) for r in routing.route_alerts(df, "labels", "ts").collect()]


@pytest.mark.parametrize("labels, want", [
    ({"team": "noc", "alertname": "A"}, [("NOC Alerts", "A", 1800)]),
    ({"alertname": "A", "namespace": "n"}, [("SRE Alerts", "A|n", 14400)]),
    ({"team": "sre", "severity": "critical", "alertname": "SLOBurn", "namespace": "n"}, [("SRE Alerts", "SLOBurn|n", 14400)]),
    ({"team": "sre", "severity": "critical", "alertname": "Pod", "namespace": "n"}, [("SRE Alerts", "Pod|n", 14400), ("email-critical", "Pod|critical", 1800)]),
    ({"source": "security", "severity": "warning", "alertname": "F"}, [("SOC Alerts", "F||", 3600)]),
])
def test_routes(spark, labels, want):
    assert routes(spark, labels) == want


def test_repeat_uses_group_interval(spark):
    rows = spark.createDataFrame([("g", at(s), 1800, 3600) for s in range(1, 10_801, 600)], "g string, ts timestamp_ntz, repeat_s int, interval_s int")
    got = sorted((r["sent_at"] - T0).total_seconds() for r in routing.repeat_suppress(rows, ["g"], "ts", "repeat_s", "interval_s").collect())
    assert got == [3600, 7200, 10800]


ALERT = "ns string, rule string, ts timestamp_ntz, alertname string, source string"
SIGNAL = "ns string, ts timestamp_ntz, kind string, name string, weight double, is_novel boolean, security_correlated boolean"


def assembled(spark, alerts, signals=()):
    return incidents.assemble_incidents(spark.createDataFrame(alerts, ALERT), spark.createDataFrame(list(signals), SIGNAL)).collect()


def test_repeat_alert_is_one_incident(spark):
    got = assembled(spark, [("a", None, at(0), "X", "probe"), ("a", None, at(1), "X", "probe")])
    assert [(r["n_alerts"], r["domain"]) for r in got] == [(2, "MIXED")]


def test_five_namespaces_are_five_incidents(spark):
    assert len(assembled(spark, [(f"n{i}", None, at(0), "X", "probe") for i in range(5)])) == 5


def test_security_rule_is_soc(spark):
    assert assembled(spark, [("a", "Terminal shell in container", at(0), "X", "probe")])[0]["domain"] == "SOC"


@pytest.mark.parametrize("source", ["sre", "observability"])
def test_infrastructure_label_is_sre(spark, source):
    assert assembled(spark, [("a", None, at(0), "X", source)])[0]["domain"] == "SRE"


def test_novel_pattern_is_not_promoted_by_the_first_alert(spark):
    novel = [("a", at(-60), "pattern", "t", 1.0, True, False)]
    r = assembled(spark, [("a", None, at(0), "X", "sre")], novel)[0]
    assert (r["domain"], r["route"]) == ("MIXED", "novel")
    r = assembled(spark, [("a", None, at(0), "X", "sre"), ("a", None, at(60), "X", "sre")], novel)[0]
    assert r["domain"] == "SRE"  # a merged alert upgrades


def test_gap_of_thirty_minutes_opens_anew(spark):
    rows = [("a", None, at(0), "X", "p"), ("a", None, at(fv.DEDUP_GAP_S - 1), "X", "p"), ("b", None, at(0), "X", "p"), ("b", None, at(fv.DEDUP_GAP_S), "X", "p")]
    got = incidents.incident_sessions(spark.createDataFrame(rows, ALERT)).collect()
    assert sorted((r["ns"], r["n_alerts"]) for r in got) == [("a", 2), ("b", 1), ("b", 1)]


def test_no_alerts_no_incidents(spark):
    assert incidents.incident_sessions(spark.createDataFrame([], ALERT)).count() == 0


def test_severity_folds(spark):
    df = spark.createDataFrame([("CRITICAL",), ("Warning",), ("notice",), ("odd",), (None,)], "s string")
    assert [r[0] for r in df.select(shape.fold_severity("s")).collect()] == ["critical", "warn", "info", "odd", None]


def test_knn_equals_brute_force(spark):
    import numpy as np

    rng = np.random.RandomState(3)
    v = rng.randn(120, 6)
    v[7] = v[3]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")
    got = {}
    for r in similar.knn(df, df, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbour_id"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 12)
    for i in range(len(v)):
        want = [j for j in sorted(range(len(v)), key=lambda j: (d[i, j], j)) if j != i][:3]
        assert [j for _, j in sorted(got[i])] == want
