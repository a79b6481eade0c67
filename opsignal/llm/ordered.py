"""Order within groups and look-ups by key, where one group or key may hold a third of all rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsignal.llm.common import written

WORD = "[^\\x20\\x09-\\x0D]+"
HOT_SHARE = 1000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; turns with equal digests count as equal. The role's length before it keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered(rows: DataFrame, group: str, order: list[str], label: str, mark: Column | None = None) -> DataFrame:
    """rows, written, with at (place within the group, from 1), last (no later row) and before (an earlier row has the mark).

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks; each task counts from its
    first row, and what a group has in earlier parts is added afterwards. At most two groups of a part reach into
    another, so the table of these sums has two rows a part at most and is sent to all tasks. Nulls come first.
    """
    extra = [T.StructField("__part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("before", T.BooleanType()),
             T.StructField("__edge", T.BooleanType()), T.StructField("last", T.BooleanType())]
    marked = rows.withColumn("__mark", F.coalesce(mark, F.lit(False)) if mark is not None else F.lit(False))
    schema = T.StructType([*marked.schema.fields, *extra])

    def run(batches):
        part = TaskContext.get().partitionId()
        held, count, seen, first = None, 0, 0, True  # the row whose follower isn't known yet; of its group: rows, marks, first of the part

        def out(t: pa.Table, last: np.ndarray, edge: np.ndarray):
            for b in t.append_column("__edge", pa.array(edge)).append_column("last", pa.array(last)).to_batches():
                yield b

        for b in batches:
            if not b.num_rows:
                continue
            t, n = pa.Table.from_batches([b]), b.num_rows
            g = t[group].combine_chunks()
            new = np.ones(n, dtype=bool)
            new[1:] = _differ(g.slice(1), g.slice(0, n - 1))
            if held is not None:
                new[0] = _differ(g.slice(0, 1), held[group].combine_chunks())[0]
                yield from out(held, new[:1], np.array([first]))
            at, marks = np.arange(n), np.array(t["__mark"].combine_chunks().to_numpy(zero_copy_only=False), dtype=np.int64)
            start = np.maximum.accumulate(np.where(new, at, 0))
            carried = np.cumsum(new) == 0
            done = np.cumsum(marks) - marks
            place = at - start + 1 + np.where(carried, count, 0)
            earlier = done - done[start] + np.where(carried, seen, 0)
            firsts = np.cumsum(new) == (1 if held is None else 0)
            firsts &= held is None or first
            t = t.append_column("__part", pa.array(np.full(n, part, dtype=np.int32))).append_column("at", pa.array(place))
            t = t.append_column("before", pa.array(earlier > 0))
            yield from out(t.slice(0, n - 1), new[1:], firsts[:-1])
            held, count, seen, first = t.slice(n - 1), int(place[-1]), int(earlier[-1] + marks[-1]), bool(firsts[-1])
        if held is not None:
            yield from out(held, np.array([True]), np.array([True]))

    dealt = marked.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(dealt.mapInArrow(run, schema), label)
    ends = placed.filter("last AND __edge").select(F.col(group).alias("__g"), F.col("__part").alias("__p"), "at", (F.col("before") | F.col("__mark")).alias("seen"))
    by = Window.partitionBy("__g").orderBy("__p")
    sums = ends.select(
        "__g", "__p", F.sum("at").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("__n"),
        F.max("seen").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("__seen"), F.lead("__p").over(by).isNotNull().alias("__more"),
    ).filter("__n IS NOT NULL OR __more")
    there = placed.join(F.broadcast(sums), (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    return there.select(
        *rows.columns, (F.col("at") + F.coalesce("__n", F.lit(0))).alias("at"),
        (F.col("before") | F.coalesce("__seen", F.lit(False))).alias("before"), (F.col("last") & ~F.coalesce("__more", F.lit(False))).alias("last"),
    )


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    unlike = pc.fill_null(pc.not_equal(a, b), True)
    return pc.and_not(unlike, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def joined(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of rows with lookup (one row a key; weight: how many rows have it, of total), whose keys may be hot.

    Keys that a thousandth of all rows have, a thousand at most, are sent to all tasks; the others meet by a shuffle.
    """
    hot = F.broadcast(lookup.filter(F.col(weight) * HOT_SHARE >= total).drop(weight))
    cold = lookup.filter(F.col(weight) * HOT_SHARE < total).drop(weight)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, "left"))


def hashed_in_order(pieces: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """key, sha256 (hex) of the texts of each key's rows, comma-joined in the order. One hash runs through its rows one by
    one, as SHA-256 must; nothing but its state is kept."""

    def run(batches):
        now, h = None, None
        for b in batches:
            keys, sums = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h is None or k != now:
                    if h is not None:
                        keys.append(now)
                        sums.append(h.hexdigest())
                    now, h = k, hashlib.sha256(t.encode())
                else:
                    h.update(b"," + t.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(sums, pa.string())], names=[key, "sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], b.column(0).type), pa.array([h.hexdigest()])], names=[key, "sha256"])

    dealt = pieces.repartition(key).sortWithinPartitions(key, *order).select(key, text)
    return dealt.mapInArrow(run, T.StructType([pieces.schema[key], T.StructField("sha256", T.StringType())]))
