"""Partition life cycle and ingest with quarantine."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsignal.sources import payloads, sinks
from opsignal.streaming import windows

SCHEMA = "k long, ts timestamp_ntz, v long"


def day(month, d=1):
    return dt.datetime(2024, month, d)


@pytest.fixture
def path(spark, tmp_path):
    rows = [(m * 100 + d, day(m, d), 1) for m in (1, 2, 3, 4) for d in (1, 9, 28)]
    sinks.append_monthly(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"), "ts", ["k"])
    return str(tmp_path / "t")


def read(spark, path, start=day(1), end=day(12)):
    return {r["k"]: r["v"] for r in sinks.read_months(spark, path, SCHEMA, start, end, "ts").collect()}


def test_a_span_reads_only_its_months(spark, path):
    df = sinks.read_months(spark, path, SCHEMA, day(2, 9), day(3, 9), "ts")
    assert sorted(r["k"] for r in df.collect()) == [209, 228, 301]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-02" in plan


def test_expiry_drops_whole_months(spark, path):
    assert sinks.expire_months(spark, path, day(3, 15), 30) == ["2024-01"]
    assert sinks.stored_months(spark, path) == ["2024-02", "2024-03", "2024-04"]
    assert sinks.expire_months(spark, path, day(3, 15), 30) == []
    sinks.append_monthly(spark.createDataFrame([(900, day(1, 5), 7)], SCHEMA), path, "ts", ["k"])  # written again
    assert read(spark, path)[900] == 7
    assert sinks.expire_months(spark, path + "-none", day(3), 1) == []


def test_replacing_a_month_leaves_the_others(spark, path):
    for _ in range(2):
        sinks.replace_months(spark.createDataFrame([(301, day(3), 5), (399, day(3, 30), 5)], SCHEMA), path, "ts", ["k"])
        got = read(spark, path)
        assert {k: v for k, v in got.items() if 300 <= k < 400} == {301: 5, 399: 5} and len(got) == 11


def test_latest_wins_however_often_a_batch_comes(spark, path):
    batch = [(101, day(1), 9), (109, day(1, 9), 0), (500, day(5), 3), (500, day(5), 4)]
    for _ in range(2):
        sinks.latest_months(spark.createDataFrame(batch, SCHEMA), path, SCHEMA, "ts", ["k"], "v", ["k"])
        got = read(spark, path)
        assert (got[101], got[109], got[500], got[201], len(got)) == (9, 1, 4, 1, 13)


def test_missing_columns_get_defaults(spark):
    df = sinks.add_missing_columns(spark.createDataFrame([(1,)], "a int"), {"a": 5, "b": "x"})
    assert tuple(df.first()) == (1, "x")


LINES = ['{"log":"a","severity":"Error"}', "{broken", "", None, "   ", "<13>plain text", '{"Channel":"Security","Message":"m"}', '{"a":1}']


def test_streamed_ingest_equals_batch_and_counts_once(spark, tmp_path):
    raw = spark.createDataFrame([(i, x, "h") for i, x in enumerate(LINES)], "id long, raw string, conn_host string")
    for k in (0, 1):
        raw.filter(F.col("id") % 2 == k).coalesce(1).write.parquet(str(tmp_path / f"in/p={k}"))
    stream = lambda: spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p=*"))
    write, tries = windows.ingest_batches(str(tmp_path / "out")), []

    def failing(df, batch):
        write(df, batch)
        tries.append(batch)
        if len(tries) == 1:
            raise RuntimeError("lost after writing")

    def run(fn):
        return stream().writeStream.foreachBatch(fn).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost after writing"):
        run(failing).awaitTermination(120)
    assert run(failing).awaitTermination(120)
    assert tries[:2] == [0, 0]  # the first batch came again
    good, bad = payloads.split_logs(raw)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(spark.read.parquet(str(tmp_path / "out/logs")).drop("batch")) == key(good)
    got = spark.read.parquet(str(tmp_path / "out/quarantine")).drop("batch")
    assert key(got) == key(bad)
    assert {r["id"]: r["fault"] for r in got.collect()} == {1: "json", 2: "empty", 3: "empty", 4: "empty"}
