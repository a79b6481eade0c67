import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from opsignal.operators import templates

MASKS = [r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", r"\b[0-9a-fA-F]{8,}\b", r"[0-9]+"]


def lines(n=3000, seed=5):
    r = random.Random(seed)
    hot = [("hot", f"get {r.choice('abcdefghij')}{'x' * r.randint(0, 40)} from {r.choice('uvw')}", r.randint(0, 99)) for _ in range(n)]
    few = [(f"ns{i % 7}", f"put {c} at {i} 10.0.0.{i}", i) for i in range(60) for c in "ab"]
    none = [(None, f"get {'y' * i} from x", i) for i in range(20)]
    return hot + few + none + [("ns1", "", 3), ("ns1", "  ", 3), ("ns2", None, 3), ("ns2", "a  b", None)]


def expected(rows, max_values=5, max_share=0.4):
    counted = defaultdict(list)
    for ns, line, ts in rows:
        for m in MASKS:
            line = line and re.sub(m, "<*>", line)
        if line and line.strip(" "):
            counted[ns, re.sub(r"\s+", " ", line.strip(" "))].append(ts)
    groups = defaultdict(list)
    for ns, line in counted:
        groups[ns, line.count(" "), line.split(" ")[0]].append(line)
    out = defaultdict(list)
    for (ns, n, _), found in groups.items():
        values = [len({x.split(" ")[i] for x in found}) for i in range(n + 1)]
        is_open = [ns is not None and v > max_values and v > max_share * len(found) for v in values]
        for x in found:
            out[ns, " ".join("<*>" if o else t for o, t in zip(is_open, x.split(" ")))] += counted[ns, x]
    return {k: (len(v), min((t for t in v if t is not None), default=None)) for k, v in out.items()}


def mined(spark, rows):
    return templates.mine_templates(spark.createDataFrame(rows, "ns string, line string, ts long"), ["ns"], "line", "ts")


def test_templates_are_those_of_a_plain_count(spark):
    rows = lines()
    got = {(r["ns"], r["template"]): (r["samples_count"], r["first_seen"]) for r in mined(spark, rows).collect()}
    assert got == expected(rows)
    assert ("hot", "get <*> from u") not in got and any("<*>" in t for _, t in got)
    few = lines(30)
    assert {(r["ns"], r["template"]): (r["samples_count"], r["first_seen"]) for r in mined(spark, few).collect()} == expected(few)


def test_tokens_are_counted_where_the_lines_lie(spark):
    df = mined(spark, lines())
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    assert not [x for x in plan.splitlines() if "Exchange" in x and "_token" in x]


def test_each_line_is_masked_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(line):
        seen.add(1)
        return line

    rows = [(f"ns{i % 3}", f"get {i} {chr(97 + i % 26)}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "ns string, line string, ts long").withColumn("line", read("line"))
    assert templates.mine_templates(df, ["ns"], "line", "ts").count() > 0
    assert seen.value == len(rows)
