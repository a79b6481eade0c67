"""Keyed-state streams: split, shuffled, repeated and restarted input gives what the batch operators give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opsignal.operators import incidents, templates
from opsignal.streaming import keyed, windows

T0 = dt.datetime(2024, 1, 1)
EVENTS = "ns string, ts timestamp, kind string, id long, rule string, alertname string, source string, status string"
END = dt.datetime(2030, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def state(spark):
    keyed.use_keyed_state(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


class Stream:
    """Feeds parts as files, one batch each; every run() is a restart from the same checkpoint."""

    def __init__(self, spark, folder, schemas, op):
        self.spark, self.folder, self.schemas, self.op, self.n = spark, folder, schemas, op, 0
        for k in schemas:
            (folder / k).mkdir()

    def feed(self, **parts):
        for k, rows in parts.items():
            self.n += 1
            self.spark.createDataFrame(rows, self.schemas[k]).coalesce(1).write.parquet(str(self.folder / k / f"p={self.n:03d}"))

    def run(self):
        read = lambda k: self.spark.readStream.schema(self.schemas[k]).option("maxFilesPerTrigger", 1).parquet(str(self.folder / k / "p=*"))
        df = self.op(*[read(k) for k in self.schemas])
        q = df.writeStream.outputMode("append").foreachBatch(windows.append_batches(str(self.folder / "out"))).option("checkpointLocation", str(self.folder / "cp"))
        assert q.trigger(availableNow=True).start().awaitTermination(300)
        return self.spark.read.parquet(str(self.folder / "out")).drop("batch").collect()


def parts(rows, size, when, late):
    """Rows in parts, out of order by less than the lateness."""
    rng = random.Random(1)
    dealt = sorted(rows, key=lambda r: (r[when] - T0).total_seconds() + rng.random() * late)
    return [dealt[k : k + size] for k in range(0, len(dealt), size)]


def test_incidents_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), at(rng.randrange(40_000)), "alert", i, rng.choice([None, None, "r1", "r2"]), f"A{i % 2}", rng.choice(["sre", None]), None) for i in range(160)]
    rows += [(ns, at(s), "resolved", 1000 + s, None, None, None, None) for ns in "ab" for s in (9000, 21_000)]
    s = Stream(spark, tmp_path, {"events": EVENTS}, lambda e: keyed.incident_changes(e, "20 minutes"))
    cut = parts(rows, 60, 1, 600)
    for p in cut[:2]:
        s.feed(events=p)
    s.run()
    s.feed(events=cut[1])  # once more
    for p in cut[2:]:
        s.feed(events=p)
    s.feed(events=[("z", END, "resolved", 1, None, None, None, None)])
    got = {}
    for r in sorted(s.run(), key=lambda r: (r["at_us"], r["n_alerts"], r["change"] == "resolved")):
        if r["ns"] != "z" and r["change"] != "forgotten":
            got[r["incident_id"]] = (r["ns"], r["rule"], r["opened_us"], r["window_end_us"], r["n_alerts"], r["alert_rank"], r["status"])
    df = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumnRenamed("id", "event_id")
    ends = df.filter("kind = 'resolved'").select("ns", "ts")
    alerts = df.filter("kind = 'alert'")
    want = incidents.incident_lifecycle(alerts, ends).select(
        "incident_id", "ns", "rule", incidents.epoch_us("opened_at"), incidents.epoch_us("window_end"), "n_alerts", "alert_rank", "status"
    )
    assert got == {r[0]: tuple(r)[1:] for r in want.collect()}
    closed = [r for r in s.run() if r["change"] == "resolved"]
    assert len(closed) == len({r["incident_id"] for r in closed})


def test_work_that_takes_too_long_is_closed_without_a_row(spark, tmp_path):
    alert = lambda ns, s, i, rule=None: (ns, at(s), "alert", i, rule, "A", None, None)
    status = lambda ns, s, i, v: (ns, at(s), "status", i, None, None, None, v)
    s = Stream(spark, tmp_path, {"events": EVENTS}, lambda e: keyed.incident_changes(e, "1 minute", age_s=2700, keep_s=86_400))
    s.feed(events=[alert("a", 0, 1, "r"), alert("a", 5, 2), status("a", 10, 3, "validating"), alert("b", 0, 4), status("b", 5, 5, "validating"), ("b", at(100), "resolved", 6, None, None, None, None)])
    s.feed(events=[alert("z", 4000, 7)])
    s.run()
    s.feed(events=[alert("a", 4100, 8, "r"), alert("z", 200_000, 9)])
    s.feed(events=[alert("z", 400_000, 10)])
    got = [(r["change"], r["at_us"] // 1_000_000 - 1704067200, r["status"], r["outcome"]) for r in sorted(s.run(), key=lambda r: r["at_us"]) if r["ns"] == "a"]
    assert got == [
        ("opened", 0, "open", None), ("merged", 5, "open", None), ("status", 10, "validating", None), ("stale", 2700, "resolved", "auto-resolved"),
        ("opened", 4100, "open", None), ("forgotten", 90_500, "open", None),
    ]


def test_streaks_equal_batch(spark, tmp_path):
    rng = random.Random(6)
    opened = [(rng.choice("ab"), f"i{k}", at(rng.randrange(20_000))) for k in range(30)]
    noise = [(rng.choice("ab"), at(rng.randrange(24_000))) for _ in range(60)]
    noise += [(ns, t + dt.timedelta(seconds=s)) for ns, _, t in opened[:4] for s in (0, 60, 600, 1800, 1801)]  # on the edges of polls
    s = Stream(spark, tmp_path, {"i": "ns string, incident_id string, ts timestamp", "n": "ns string, ts timestamp"}, lambda i, n: keyed.clear_streaks(i, n, "30 minutes"))
    a, b = parts(opened, 15, 2, 300), parts(noise, 40, 1, 300)
    s.feed(i=a[0], n=b[0])
    s.run()
    s.feed(i=a[0], n=b[0])
    for x in a[1:]:
        s.feed(i=x)
    for x in b[1:]:
        s.feed(n=x)
    s.feed(i=[("z", "end", END)], n=[("z", END)])
    got = {r["incident_id"]: (r["outcome"], r["polls"]) for r in s.run()}
    ntz = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = incidents.clear_streaks(ntz(opened, "ns string, incident_id string, ts timestamp"), ntz(noise, "ns string, ts timestamp").withColumnRenamed("ts", "at"), "incident_id", "ns", "ts", "at")
    assert got == {r["incident_id"]: (r["outcome"], r["polls"]) for r in want.collect()} and {o for o, _ in got.values()} == {"resolved", "escalated"}


def test_known_patterns_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    seen = [(f"p{rng.randrange(6)}", at(rng.randrange(100_000))) for _ in range(120)] + [("rare", at(10)), ("rare", at(90_000))]
    s = Stream(spark, tmp_path, {"s": "pattern_id string, ts timestamp"}, lambda x: keyed.novel_patterns(x, "20 minutes", 8000))
    cut = parts(seen, 50, 1, 900)
    s.feed(s=cut[0])
    s.run()
    s.feed(s=cut[0])
    for p in cut[1:]:
        s.feed(s=p)
    s.feed(s=[("end", END)])
    got = sorted((r["pattern_id"], r["first_seen_us"]) for r in s.run())
    df = spark.createDataFrame(seen, "pattern_id string, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = templates.novel_sightings(df, 8000).select("pattern_id", incidents.epoch_us("first_seen"))
    assert got == sorted(map(tuple, want.collect())) and len([g for g in got if g[0] == "rare"]) == 2
