import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest

from opsignal.operators import correlate

T0 = dt.datetime(2024, 3, 1)
INCIDENT = "incident_id long, incident_type string, ns string, opened_at timestamp_ntz"
SAMPLE = "ns string, metric string, ts timestamp_ntz, value double"
LOOK, GAP, STEP = 3600, 60, 300


def at(s):
    return T0 + dt.timedelta(seconds=s)


def samples(seed=3):
    r = random.Random(seed)
    rows = [(f"ns{r.randint(0, 2)}", r.choice(["cpu", "mem"]), at(r.uniform(0, 20000)), r.uniform(0, 50)) for _ in range(900)]
    flat = [("ns1", "flat", at(s), 7.3) for s in range(0, 20000, 100)]
    return rows + flat + [("ns0", "gone", at(s), None) for s in range(0, 20000, 200)] + [(None, "cpu", at(50), 1.0)]


def incidents(n=60, seed=4):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "b"]), f"ns{i % 3}", at(r.uniform(0, 22000))) for i in range(n)]
    edges = [(900 + i, "a", "ns1", at(s)) for i, s in enumerate((6000, 6060, 6059.999999, 6060.000001, 9600, 9599.999999))]
    return rows + rows[:5] + [(*x[:3], at(15000)) for x in rows[5:10]] + edges + [(None, "a", "ns0", at(s)) for s in (4000, 9000)] + [(70, "a", None, at(50))]


def expected(incs, smps):
    cells = defaultdict(list)
    for ns, metric, ts, value in smps:
        cells[ns, metric, int((ts - T0).total_seconds() // STEP)].append(value)
    grid = {k: np.mean(x) if (x := [v for v in vs if v is not None]) else None for k, vs in cells.items()}
    points = defaultdict(list)
    for i, kind, ns, opened in incs:
        for (g, metric, c), v in grid.items():
            x = c * STEP - (opened - T0).total_seconds()
            if ns is not None and g == ns and -LOOK - 1e-9 <= x <= -GAP + 1e-9:
                points[i, kind, ns, metric].append((x, v))
    out = {}
    for k, p in points.items():
        if len(p) >= 3:
            x, y = np.array([a for a, b in p if b is not None]), np.array([b for _, b in p if b is not None])
            if not len(y):
                out[k] = (len(p), 0.0, None)
                continue
            xx = ((x - x.mean()) ** 2).sum()
            sd = y.std(ddof=1) if len(y) > 1 else 0.0
            out[k] = (len(p), ((x - x.mean()) * (y - y.mean())).sum() / xx if xx else 0.0, max(y.max() - y.mean(), y.mean() - y.min()) / sd if sd > 1e-9 else None)
    return out


def features(spark, incs, smps):
    return correlate.lead_up_features(
        spark.createDataFrame(incs, INCIDENT), spark.createDataFrame(smps, SAMPLE), ["ns"], "opened_at", "ts", LOOK, GAP, STEP
    )


def test_features_are_those_of_all_points(spark):
    got = {(r["incident_id"], r["incident_type"], r["ns"], r["metric"]): (r["n"], r["slope"], r["peak_z"]) for r in features(spark, incidents(), samples()).collect()}
    want = expected(incidents(), samples())
    assert got.keys() == want.keys() and any(k[3] == "gone" for k in got)
    for k, (n, slope, z) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(slope, abs=1e-9), k
        assert got[k][2] == (None if z is None else pytest.approx(z, rel=1e-7)), k


def test_pairs_follow_the_windows_not_the_incidents(spark, monkeypatch):
    formed = []
    plain = correlate.interval_join

    def counted(*args, **more):
        formed.append(plain(*args, **more))
        return formed[-1]

    monkeypatch.setattr(correlate, "interval_join", counted)
    rows = [(i, "a", f"ns{i % 3}", at(9000 + i % 200)) for i in range(600)]
    once = features(spark, rows, samples()).count()
    assert features(spark, [(i * 1000 + j, *x[1:]) for i, x in enumerate(rows) for j in range(20)], samples()).count() == 20 * once
    assert formed[1].count() == formed[0].count() <= 6 * 4 * (LOOK // STEP + 1)
