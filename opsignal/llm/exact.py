"""Exact dedup against a minimal perfect hash of historical digests.

The history's distinct digests are dealt into shards. Each shard is one row: the levels of a minimal perfect hash
(at each level a key that meets no other key in its bit keeps it; the rest go on to the next level) and, at the slot that
the hash gives a key, the full digest, the locator of the document that stays, and the size of the group. Documents are
looked up shard by shard; a slot counts only if its digest equals the document's, byte by byte. Digests that the
history doesn't hold are grouped by a plain aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal.llm.common import written

DIGEST = 32
INDEX = "shard long, widths array<int>, bits binary, digests binary, winners array<long>, sizes array<long>"
FOUND = "doc_id long, digest binary, member boolean, winner long, size long"


def _places(halves: np.ndarray, level: int, width: int) -> np.ndarray:
    """Bit of each key at a level; halves: two unsigned 64-bit numbers of each digest."""
    with np.errstate(over="ignore"):
        x = halves[:, 0] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + halves[:, 1]
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(width)).astype(np.int64)


def _halves(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw[:, :16]).view(np.uint64)


def build_hash(raw: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Widths of the levels, all their bits, and the slot of each key. raw: distinct digests, one a row."""
    halves, rest = _halves(raw), np.arange(len(raw))
    widths, bits = [], []
    home = np.zeros(len(raw), dtype=np.int64)
    while len(rest):
        width = 2 * len(rest) + 1
        at = _places(halves[rest], len(widths), width)
        alone = np.bincount(at, minlength=width) == 1
        own = alone[at]
        home[rest[own]] = sum(widths) + at[own]
        widths.append(width)
        bits.append(alone)
        rest = rest[~own]
    whole = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
    return widths, whole, (np.cumsum(whole) - 1)[home] if len(raw) else home


def find(raw: np.ndarray, widths: list[int], bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 where the hash's slot holds other bytes or there is none."""
    slot, rest, base = np.full(len(raw), -1, dtype=np.int64), np.arange(len(raw)), 0
    rank, halves = np.cumsum(bits) - 1, _halves(raw)
    for level, width in enumerate(widths):
        at = base + _places(halves[rest], level, width)
        hit = bits[at]
        slot[rest[hit]] = rank[at[hit]]
        rest, base = rest[~hit], base + width
    there = slot >= 0
    there[there] = (digests[slot[there]] == raw[there]).all(axis=1)
    return np.where(there, slot, -1)


def _raw(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, DIGEST)


def _build(t: pa.Table) -> pa.Table:
    raw = _raw(t["digest"])
    widths, bits, slot = build_hash(raw)
    order = np.argsort(slot)
    return pa.table(
        {
            "shard": pa.array([t["shard"][0].as_py()], pa.int64()),
            "widths": pa.array([widths], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "digests": pa.array([raw[order].tobytes()], pa.binary()),
            "winners": pa.array([t["winner"].take(order).to_pylist()], pa.list_(pa.int64())),
            "sizes": pa.array([t["size"].take(order).to_pylist()], pa.list_(pa.int64())),
        }
    )


def _look_up(docs: pa.Table, index: pa.Table) -> pa.Table:
    n = docs.num_rows
    slot, winners, sizes = np.full(n, -1, dtype=np.int64), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())
    if n and index.num_rows:
        row = {k: index[k][0] for k in ("widths", "bits", "digests", "winners", "sizes")}
        widths = row["widths"].as_py()
        bits = np.unpackbits(np.frombuffer(row["bits"].as_py(), dtype=np.uint8))[: sum(widths)].astype(bool)
        slot = find(_raw(docs["digest"]), widths, bits, np.frombuffer(row["digests"].as_py(), dtype=np.uint8).reshape(-1, DIGEST))
        take = pa.array(slot, mask=slot < 0)
        winners, sizes = row["winners"].values.take(take), row["sizes"].values.take(take)
    return pa.table({"doc_id": docs["doc_id"], "digest": docs["digest"], "member": pa.array(slot >= 0), "winner": winners, "size": sizes})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest: SHA-256 of the text's UTF-8; a null text counts as empty."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))


def _shard(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n))


def build_index(history: DataFrame, keys_per_shard: int = 8192) -> tuple[DataFrame, int]:
    """The index of digests(history), one row per shard, written to the shared folder, and the number of shards.

    Equal digests are summed up before the shuffle, so a text that a third of all rows share is one key.
    """
    known = written(history.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size")), "known")
    shards = max(1, -(-known.count() // keys_per_shard))
    rows = known.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, INDEX)
    return written(rows, "index"), shards


def look_up(rows: DataFrame, index: DataFrame, shards: int, rows_per_task: int = 65536) -> DataFrame:
    """doc_id, digest, member, winner, size for each row of digests(docs), from the index.

    A shard with more than rows_per_task rows is cut into pieces by a hash of doc_id, each with its own copy of
    the shard's index row, so copies of one text are spread over tasks.
    """
    rows = rows.withColumn("shard", _shard(shards))
    pieces = rows.groupBy("shard").count().select("shard", F.ceil(F.col("count") / rows_per_task).alias("pieces"))
    dealt = rows.join(pieces, "shard").select("doc_id", "digest", "shard", F.pmod(F.xxhash64("doc_id"), "pieces").alias("piece"))
    copies = index.join(pieces, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))).drop("pieces")
    return dealt.groupBy("shard", "piece").cogroup(copies.groupBy("shard", "piece")).applyInArrow(_look_up, FOUND)


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text; other columns are ignored).

    keep_id: largest doc_id among the history's rows of the same text if the history holds it, else among docs'; kept:
    doc_id is keep_id. history: earlier documents (doc_id, text), by default docs itself. A null text counts as
    empty. A null doc_id ranks below all others; if a group has no other, all its rows are kept. Rows that repeat a
    doc_id and text are one document: they count in group_size and share the decision. No rows give no rows.
    """
    rows = digests(docs)
    index, shards = build_index(rows if history is None else digests(history))
    found = written(look_up(rows, index, shards), "found")
    new = found.filter(~F.col("member"))
    groups = new.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))
    both = found.filter("member").unionByName(new.select("doc_id", "digest", "member").join(groups, "digest").select(*found.columns))
    return both.select(
        "doc_id", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
