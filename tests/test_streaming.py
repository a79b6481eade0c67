import datetime as dt

import pytest

from opsignal.streaming import windows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ns string, rule string, ts timestamp"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def events():
    rows = [(i, f"ns{i % 2}", None if i % 3 else "r", at(i * 400)) for i in range(12)]
    return [*rows, (100, "ns9", None, at(10_000_000))]  # moves the watermark past all of them


def streamed(spark, tmp_path, parts, op, mode="append"):
    """What op gives for the parts as one batch after the other."""
    src, out = tmp_path / "src", tmp_path / "out"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src / f"p={i}"))
    df = op(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src / "p=*")))
    q = df.writeStream.outputMode(mode).foreachBatch(windows.append_batches(str(out))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(str(out)).drop("batch").collect()), key=str)


def final(rows):
    return [r for r in rows if "ns9" not in r]


def test_tumbling_equals_batch(spark, tmp_path, events):
    op = lambda df: windows.window_counts(df, ["ns"], "ts", "10 minutes", "1 minute")
    want = sorted(map(tuple, op(spark.createDataFrame(events, SCHEMA)).collect()), key=str)
    assert final(streamed(spark, tmp_path, [events[:5], events[5:12], events[12:]], op)) == final(want)


def test_duplicates_across_batches(spark, tmp_path, events):
    op = lambda df: windows.distinct_events(df, ["id"], "ts", "1 day").select("id")
    got = streamed(spark, tmp_path, [events[:6], events[3:12]], op)
    assert [g[0] for g in sorted(got)] == list(range(12))


def test_sessions_equal_batch(spark, tmp_path, events):
    op = lambda df: windows.incident_sessions(df, "ns", "rule", "ts", 1800, "1 minute")
    want = sorted(map(tuple, op(spark.createDataFrame(events, SCHEMA)).collect()), key=str)
    assert final(streamed(spark, tmp_path, [events[:7], events[7:]], op)) == final(want)


def test_session_gap_is_exclusive(spark):
    rows = [(1, "a", None, at(0)), (2, "a", None, at(1800)), (3, "b", None, at(0)), (4, "b", None, at(1799))]
    got = windows.incident_sessions(spark.createDataFrame(rows, SCHEMA), "ns", "rule", "ts", 1800, "1 minute").collect()
    assert sorted((r["ns"], r["n_alerts"]) for r in got) == [("a", 1), ("a", 1), ("b", 2)]


def test_interval_join_bounds(spark):
    t = spark.createDataFrame([(1, "a", None, at(600))], SCHEMA)
    s = spark.createDataFrame([(i, "a", None, at(x)) for i, x in enumerate([0, 300, 299, 599, 600])], SCHEMA).selectExpr("id sid", "ns", "ts sts")
    got = windows.interval_join(t, s, ["ns"], "ts", "sts", "5 minutes", "1 minute").collect()
    assert sorted(r["sid"] for r in got) == [1, 3]


def test_sliding_equals_batch(spark, tmp_path, events):
    op = lambda df: windows.window_counts(df, ["ns"], "ts", "20 minutes", "1 minute", "5 minutes")
    want = sorted(map(tuple, op(spark.createDataFrame(events, SCHEMA)).collect()), key=str)
    got = streamed(spark, tmp_path, [events[:5], events[5:12], events[12:]], op)
    assert final(got) == final(want) and sum(r[3] for r in final(got)) == 4 * 12


def test_streams_join_as_batches_do(spark, tmp_path):
    """Triggers and signals in separate streams, cut and out of order."""
    triggers = [(i, f"ns{i % 2}", None, at(i * 500)) for i in range(12)] + [(900, "ns9", None, at(10_000_000))]
    signals = [(i, f"ns{i % 2}", None, at(i * 70)) for i in range(90)] + [(901, "ns9", None, at(10_000_000))]
    for name, rows in (("t", triggers), ("s", signals)):
        order = sorted(rows, key=lambda r: (r[3] > at(9_000_000), r[0] // 40, -r[0]))
        for k in range(0, len(order), 30):
            spark.createDataFrame(order[k : k + 30], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"{name}/p={k:03d}"))
    read = lambda n: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{n}/p=*"))

    def op(t, s):
        return windows.interval_join(t, s.selectExpr("id sid", "ns", "ts sts"), ["ns"], "ts", "sts", "5 minutes", "2 hours").select("id", "sid")

    q = op(read("t"), read("s")).writeStream.foreachBatch(windows.append_batches(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp"))
    assert q.trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r["id"], r["sid"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((t[0], s[0]) for t in triggers for s in signals if t[1] == s[1] and t[3] - dt.timedelta(minutes=5) <= s[3] < t[3])
    assert got == want and len(got) > 20


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    write = windows.append_batches(str(tmp_path / "out"))
    df = spark.createDataFrame([(1, "a", None, at(0))], SCHEMA)
    for batch in (0, 1, 1, 0):
        write(df, batch)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
