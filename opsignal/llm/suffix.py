"""Repeated passages by the sorted suffixes of a collection, built column by column.

A byte goes if a string of `least` bytes over it also starts in a document with a smaller doc_id. Finding those strings
takes four questions, each asked by blocks of documents and answered by hash parts, as packed arrays:

1. Anchors. Of each window of `least` bytes the `gram`-byte string with the smallest hash is its anchor, so equal windows
   have equal anchors. Only anchors that come up more than once go on.
2. Segments. The windows that have an anchor make up a segment. A segment that a smaller document has too (by two
   hashes of 64 bits that know nothing of each other) goes. The first document of a segment whose anchor has other segments goes on with it.
3. Windows. Those of these segments whose (shortened) hash comes up once can't be repeated; the rest of each segment is a
   short string.
4. Suffixes. The strings of a part's anchors are a collection of short documents. Their suffixes are sorted by inserting
   one symbol of each document a round, from the last to the first, into the collection's Burrows-Wheeler transform, with
   the common prefixes of neighbours; both are sequential files in the task's temporary folder. Neighbours that share
   `least` bytes are equal windows, and the smallest doc_id among them decides.

An anchor that comes up very often sends its windows one by one instead, dealt by their own hash. Equal windows, segments and
strings of a block are one entry, with the smallest document that has them, so no group grows with a hot passage. What a block
has found out in one step (places, bounds, hashes) is written with its questions and read in the next.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal.llm.common import forget, session_parallelism, shared_folder, written
from opsignal.llm.lm import pack, pack_sorted, unpack, unpack_sorted

BLOCK = "block long, ids array<long>, lengths binary, text binary, anchors binary, n_anchors long"
ASKED = "block long, part int, keys binary, counts binary, base long, least binary, checks binary, state binary"
ANSWER = "block long, step int, part int, counts binary, least binary, n long"
SENT = "block long, part int, strings binary, lengths binary, docs binary, state binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
OUTSIDE = 256  # symbol of places beyond a document's ends
SHIFT, LENGTH = np.uint32(7), np.uint32(127)  # a suffix as one number: its owner, then its length

_rng = np.random.RandomState(11)
SYMBOL = _rng.randint(1, 1 << 62, size=257).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SYMBOL_2 = _rng.randint(1, 1 << 62, size=257).astype(np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR, FACTOR_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
STATE = -1  # the part of rows that hold a block's own state


@dataclass(frozen=True)
class Params:
    """least: bytes of a repeated string; gram: bytes of an anchor; block_bytes: text of a block; part_keys: entries of a
    hash part; part_strings: most strings of a collection, about; hot: places of an anchor beyond which its
    windows are sent one by one; chunk: records that the sequential files are read by."""

    least: int = 50
    gram: int = 20
    block_bytes: int = 6 << 20
    part_keys: int = 500_000
    part_strings: int = 5_000
    hot: int = 5_000
    chunk: int = 1 << 18

    @property
    def span(self) -> int:
        """Anchor places of a window."""
        return self.least - self.gram + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def rolled(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` symbols, put together from runs of powers of two."""
    with np.errstate(over="ignore"):
        power, width, whole, have = FACTOR, 1, None, 0
        part = symbols
        while True:
            if size & width:
                if whole is None:
                    whole, have = part, width
                else:  # the shorter run stands before the longer one
                    n = len(symbols) - have - width + 1
                    whole, have = whole[:n] * power + part[have : have + n], have + width
            if width * 2 > size:
                return _mixed(whole[: len(symbols) - size + 1])
            part = part[:-width] * power + part[width:]
            power, width = power * power, width * 2


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x = best(x[:-width], x[width:])
        width *= 2
    return best(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def anchors(text: np.ndarray, ends: np.ndarray, p: Params, step: int = 1 << 20) -> np.ndarray:
    """Places in the joined texts (bytes; ends: of each document) where some window inside a document has its anchor."""
    out = []
    for a in range(0, len(text) - p.least + 1, step):
        part = text[a : a + step + p.least - 1]
        grams = rolled(SYMBOL[part], p.gram)
        low = _sliding(grams, p.span, np.minimum)
        starts = np.arange(a, a + len(low))
        inside = ends[np.minimum(np.searchsorted(ends, starts, side="right"), len(ends) - 1)] - starts >= p.least
        low = np.where(inside, low, np.uint64(0))
        pad = np.zeros(p.span - 1, dtype=np.uint64)
        out.append(a + np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), p.span, np.maximum) == grams))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)


def stretches(text: np.ndarray, places: np.ndarray, before: int, after: int, step: int = 1 << 20) -> Iterator[tuple[slice, int, np.ndarray]]:
    """Places (sorted) by stretches of text: which, the first byte of the stretch, its bytes from `before` to `after`."""
    for a in range(0, len(text), step):
        i, j = np.searchsorted(places, [a, a + step])
        if i < j:
            first = max(0, a - before)
            yield slice(i, j), first, text[first : a + step + after]


def hashes_at(text: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place on; places are sorted and have so many bytes."""
    out = np.empty(len(places), dtype=np.uint64)
    for s, first, part in stretches(text, places, 0, size):
        out[s] = rolled(SYMBOL[part], size)[places[s] - first]
    return out


def row_hashes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row of symbols, of other tables and factors."""
    one, two = np.zeros(len(rows), dtype=np.uint64), np.zeros(len(rows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            column = rows[:, k]
            one = one * FACTOR + SYMBOL[column]
            two = two * FACTOR_2 + SYMBOL_2[column]
    return _mixed(one), _mixed(two)


def frozen(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one compressed string, for thawed(); places (int64) as the steps from one to the next."""
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    body = [np.diff(a, prepend=0) if a.dtype == np.int64 else np.ascontiguousarray(a) for a in arrays.values()]
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "big") + head + b"".join(a.tobytes() for a in body))


def thawed(raw: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at = 4 + int.from_bytes(raw[:4], "big")
    out = {}
    for k, kind, n in json.loads(raw[4:at]):
        a = np.frombuffer(raw, dtype=kind, count=n, offset=at)
        at += a.nbytes
        out[k] = np.cumsum(a) if a.dtype == np.int64 else a
    return out


class _Open:
    def __init__(self):
        self.ids, self.texts, self.size = [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.ids.append(doc_id)
        self.texts.append(text)
        self.size += len(text)

    def row(self, p: Params) -> dict:
        raw = b"".join(self.texts)
        lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        ends = np.cumsum(lengths)
        at = anchors(np.frombuffer(raw, dtype=np.uint8), ends, p)
        named = np.array([i is not None for i in self.ids])
        at = at[named[np.searchsorted(ends, at, side="right")]] if len(at) else at
        return {
            "block": uuid.uuid4().int >> 65, "ids": self.ids, "lengths": pack(lengths), "text": zstandard.ZstdCompressor(level=3).compress(raw),
            "anchors": pack_sorted(at.astype(np.uint64)), "n_anchors": len(at),
        }


def _schema(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_BLOCK = _schema(block=pa.int64(), ids=pa.list_(pa.int64()), lengths=pa.binary(), text=pa.binary(), anchors=pa.binary(), n_anchors=pa.int64())
_ASKED = _schema(block=pa.int64(), part=pa.int32(), keys=pa.binary(), counts=pa.binary(), base=pa.int64(), least=pa.binary(), checks=pa.binary(), state=pa.binary())
_ANSWER = _schema(block=pa.int64(), step=pa.int32(), part=pa.int32(), counts=pa.binary(), least=pa.binary(), n=pa.int64())
_SENT = _schema(block=pa.int64(), part=pa.int32(), strings=pa.binary(), lengths=pa.binary(), docs=pa.binary(), state=pa.binary())
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_RESULT = _schema(doc_id=pa.int64(), n_bytes=pa.int64(), spans=_SPANS, kept=pa.binary())


def blocks(docs: DataFrame, p: Params) -> DataFrame:
    """Documents in blocks, a bucketed table in the shared folder: what is asked later is joined without moving texts."""

    def run(batches):
        filling = _Open()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                filling.add(doc_id, (text or "").encode("utf-8", "surrogatepass"))
                if filling.size >= p.block_bytes:
                    yield pa.RecordBatch.from_pylist([filling.row(p)], schema=_BLOCK)
                    filling = _Open()
        if filling.ids:
            yield pa.RecordBatch.from_pylist([filling.row(p)], schema=_BLOCK)

    spark = docs.sparkSession
    name = f"text_blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    rows = docs.select("doc_id", "text").mapInArrow(run, BLOCK)
    rows.write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(session_parallelism(spark), "block").sortBy("block").saveAsTable(name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.table(name)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Block:
    """A block and what is known of its anchors so far."""

    def __init__(self, row: dict, p: Params, state: bytes | None = None):
        self.p, self.id = p, row["block"]
        self.ids = row["ids"]
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), dtype=np.uint8)
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        if state is not None:
            self.__dict__.update(thawed(state))
            return
        self.at = unpack_sorted(row["anchors"]).astype(np.int64)
        self.of = np.searchsorted(self.ends, self.at, side="right")
        ids = np.array([i if i is not None else 0 for i in self.ids], dtype=np.int64)
        self.doc = ids[self.of] if len(self.at) else np.zeros(0, dtype=np.int64)
        self.keys = hashes_at(self.text, self.at, p.gram)

    def state(self, *names: str) -> bytes:
        return frozen({n: getattr(self, n) for n in names})

    def state_row(self, *names: str) -> dict:
        return {"block": self.id, "part": STATE, "base": 0, "state": self.state(*names)}

    def ask(self, keys: np.ndarray, docs: np.ndarray, parts: int, checks: np.ndarray | None = None) -> Iterator[dict]:
        """One row for each part: distinct keys (and checks), how often each comes up, its smallest document."""
        if not len(keys):
            return
        order = np.lexsort((docs, keys) if checks is None else (docs, checks, keys))
        keys, docs = keys[order], docs[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        if checks is not None:
            checks = checks[order]
            new[1:] |= checks[1:] != checks[:-1]
        first = np.flatnonzero(new)
        counts, known, low, base = np.diff(first, append=len(keys)), keys[first], docs[first], int(docs.min())
        cuts = np.searchsorted(_part(known, parts), np.arange(parts + 1))
        for k in range(parts):
            s = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1]:
                yield {
                    "block": self.id, "part": k, "keys": pack_sorted(known[s]), "counts": pack(counts[s]), "base": base, "least": pack(low[s] - base),
                    "checks": None if checks is None else checks[first][s].tobytes(),
                }

    def learn_anchors(self, rows: list[dict]) -> None:
        """Keeps the anchors that come up more than once, with their segments' hashes."""
        known, which = np.unique(self.keys, return_inverse=True)
        counts = _joined(rows, "counts")[which] if len(known) else np.zeros(0)
        shared = counts > 1
        self.at, self.of, self.doc, self.keys, self.count = self.at[shared], self.of[shared], self.doc[shared], self.keys[shared], counts[shared]
        p, n = self.p, len(self.at)
        self.first, self.last = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        self.segment_keys, self.segment_checks = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
        for s, base, part in stretches(self.text, self.at, p.span, p.least + p.span, 1 << 18):
            self._segments(s, base, part)

    def _segments(self, s: slice, base: int, part: np.ndarray) -> None:
        """First and last window of each anchor in a stretch of text, and two hashes of the bytes from one to the other."""
        p, at, begin, end = self.p, self.at[s], self.begins[self.of[s]], self.ends[self.of[s]]
        grams, wide = rolled(SYMBOL[part], p.gram), p.span - 1
        places = at[:, None] + np.arange(-wide, p.span)
        inside = (places >= begin[:, None]) & (places + p.gram <= end[:, None])
        near = np.where(inside, grams[np.clip(places - base, 0, len(grams) - 1)], np.uint64(2**64 - 1)) >= grams[at - base][:, None]
        left, right = near[:, wide - 1 :: -1], near[:, wide + 1 :]
        left = np.where(left.all(axis=1), wide, left.argmin(axis=1))
        right = np.where(right.all(axis=1), wide, right.argmin(axis=1))
        first = np.maximum(at - left, begin)
        last = np.minimum(np.minimum(at, at + right - wide), end - p.least)
        places = at[:, None] + np.arange(-wide, p.least)
        inside = (places >= first[:, None]) & (places < last[:, None] + p.least)
        content, self.segment_checks[s] = row_hashes(np.where(inside, part[np.clip(places - base, 0, len(part) - 1)], OUTSIDE))
        self.first[s], self.last[s] = first, last
        with np.errstate(over="ignore"):
            self.segment_keys[s] = _mixed(self.keys[s] * FACTOR + content)

    def segment_state(self) -> dict:
        """Of each shared anchor its hash, how often it comes up, its first window, how many more there are, its segment's number."""
        order = np.lexsort((self.segment_checks, self.segment_keys))
        keys, checks = self.segment_keys[order], self.segment_checks[order]
        self.segment = np.empty(len(order), dtype=np.int32)
        if len(order):
            self.segment[order] = np.cumsum(np.concatenate([[False], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])]))
        self.count, self.wide = np.minimum(self.count, 1 << 31).astype(np.uint32), (self.last - self.first).astype(np.uint8)
        return self.state_row("keys", "count", "first", "wide", "segment")

    def learn_segments(self, rows: list[dict]) -> None:
        """Which shared anchors' segments go, and the windows of those that go on."""
        if len(self.segment):
            times, low = _joined(rows, "counts")[self.segment], _joined(rows, "least")[self.segment].astype(np.int64)
        else:
            times, low = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        gone = (times > 1) & (low < self.documents(self.first))
        on = ~gone & (times < self.count)
        self.gone_first, self.gone_wide = self.first[gone], self.wide[gone]
        self.first, self.wide, self.keys, self.hot = self.first[on], self.wide[on], self.keys[on], self.count[on] > self.p.hot
        self.spread()
        order = np.argsort(self.window, kind="stable")
        self.window_keys = np.empty(len(order), dtype=np.uint64)
        self.window_keys[order] = hashes_at(self.text, self.window[order], self.p.least)

    def documents(self, places: np.ndarray) -> np.ndarray:
        ids = np.array([i if i is not None else 0 for i in self.ids], dtype=np.int64)
        return ids[np.searchsorted(self.ends, places, side="right")] if len(places) else np.zeros(0, dtype=np.int64)

    def spread(self) -> None:
        """Anchor and first byte of each window of the anchors that go on."""
        n = self.wide.astype(np.int64) + 1
        self.anchor = np.repeat(np.arange(len(n)), n)
        self.window = np.repeat(self.first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def ask_windows(self, parts: int, bits: int) -> Iterator[dict]:
        """One row for each part: distinct hashes, shortened to their first bits, and how often each comes up; then the state."""
        known, which, counts = np.unique(self.window_keys >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        cuts = np.searchsorted(_part(known << np.uint64(64 - bits), parts), np.arange(parts + 1))
        for k in range(parts):
            s = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1]:
                yield {"block": self.id, "part": k, "keys": pack_sorted(known[s]), "counts": pack(np.minimum(counts[s], 2)), "base": 0, "least": None}
        self.which, self.hot_keys = which.astype(np.int32), self.window_keys[self.hot[self.anchor]]
        yield self.state_row("gone_first", "gone_wide", "first", "wide", "keys", "hot", "which", "hot_keys")

    def learn_windows(self, rows: list[dict]) -> None:
        """Keeps the windows that may be repeated."""
        self.spread()
        often = _joined(rows, "counts")[self.which] > 1 if len(self.which) else np.zeros(0, dtype=bool)
        self.hot_keys = self.hot_keys[often[self.hot[self.anchor]]]
        self.anchor, self.window = self.anchor[often], self.window[often]

    def outgoing(self, parts: int) -> tuple[np.ndarray, ...]:
        """What is sent on, in the order of its parts: part, first byte, length, document of each string.

        The windows of an anchor go as one string to the anchor's part; of a hot one each goes to its own hash's part.
        Whether an anchor is hot depends on its count in all blocks alone, so that all its segments take the same way.
        """
        p = self.p
        hot = self.hot[self.anchor]
        whole, at = self.anchor[~hot], self.window[~hot]
        head = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, dtype=np.int64)
        tail = np.append(head[1:], len(whole)) - 1 if len(whole) else head
        part = np.concatenate([_part(self.keys[whole[head]], parts), _part(self.hot_keys, parts)])
        start = np.concatenate([at[head], self.window[hot]])
        size = np.concatenate([at[tail] - at[head], np.zeros(hot.sum(), dtype=np.int64)]) + p.least
        order = np.argsort(part, kind="stable")
        return part[order], start[order], size[order], self.documents(start[order])

    def send(self, parts: int) -> Iterator[dict]:
        """One row for each part: its distinct strings, each with its smallest document."""
        part, start, size, doc = self.outgoing(parts)
        raw = self.text.tobytes()
        cuts = np.searchsorted(part, np.arange(parts + 1))
        # of each string the number of its distinct one, and whether a smaller document of this block has it
        self.start, self.size, self.string, self.later = start, size.astype(np.uint8), np.empty(len(start), dtype=np.int32), np.zeros(len(start), dtype=bool)
        base = 0
        for k in np.unique(part).tolist():
            s = slice(cuts[k], cuts[k + 1])
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(raw[a : a + n], len(number)) for a, n in zip(start[s].tolist(), size[s].tolist(), strict=True)], dtype=np.int64)
            low = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(low, which, doc[s])
            self.string[s], self.later[s] = base + which, doc[s] > low[which]
            base += len(number)
            strings = list(number)
            yield {
                "block": self.id, "part": k, "strings": zstandard.ZstdCompressor(level=3).compress(b"".join(strings)),
                "lengths": pack(np.array([len(x) for x in strings], dtype=np.int64)), "docs": pack(low.view(np.uint64)),
            }
        yield {"block": self.id, "part": STATE, "state": self.state("gone_first", "gone_wide", "start", "size", "string", "later")}

    def result(self, masks: np.ndarray) -> pa.Table:
        p, change = self.p, np.zeros(len(self.text) + 1, dtype=np.int32)
        np.add.at(change, self.gone_first, 1)
        np.add.at(change, self.gone_first + self.gone_wide + p.least, -1)
        if len(masks):
            own = masks[self.string]
            own[self.later] = (np.uint64(1) << (self.size[self.later].astype(np.uint64) - np.uint64(p.least - 1))) - np.uint64(1)
            for k in range(p.span):
                hit = self.start[(own >> np.uint64(k)) & np.uint64(1) == 1] + k
                np.add.at(change, hit, 1)
                np.add.at(change, hit + p.least, -1)
        removed = np.cumsum(change[:-1]) > 0
        full = self.lengths > 0
        edge = np.diff(removed.astype(np.int8), prepend=0)
        edge[self.begins[full]] = removed[self.begins[full]]  # no run crosses documents
        starts = np.flatnonzero(edge == 1)
        last = np.concatenate([removed[1:] < removed[:-1], [True]]) if len(removed) else removed
        last[self.ends[full] - 1] = True
        stops = np.flatnonzero(removed & last) + 1
        owner = np.searchsorted(self.ends, starts, side="right")
        offsets = np.searchsorted(owner, np.arange(len(self.ids) + 1))
        spans = pa.StructArray.from_arrays([pa.array(starts - self.begins[owner]), pa.array(stops - self.begins[owner])], names=["start", "stop"])
        kept_ends = np.concatenate([[0], np.cumsum(~removed)])[np.concatenate([[0], self.ends])]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.ids), [None, pa.py_buffer(kept_ends.astype(np.int64)), pa.py_buffer(self.text[~removed].tobytes())])
        return pa.Table.from_arrays(
            [pa.array(self.ids, pa.int64()), pa.array(self.lengths), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans).cast(_SPANS), kept.cast(pa.binary())], schema=_RESULT
        )


def _joined(rows: list[dict], name: str) -> np.ndarray:
    return np.concatenate([unpack(r[name]) for r in sorted(rows, key=lambda r: r["part"])])


def answer(asked: DataFrame, step: int) -> DataFrame:
    """For each key that a block asked for, in its order: how often it comes up in all blocks and its smallest document."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        whole = np.concatenate(keys)
        new = np.ones(len(whole), dtype=bool)
        if rows[0]["checks"] is not None:
            checks = np.concatenate([np.frombuffer(r["checks"], dtype=np.uint64) for r in rows])
            order = np.lexsort((checks, whole))
            new[1:] = (whole[order][1:] != whole[order][:-1]) | (checks[order][1:] != checks[order][:-1])
        else:
            order = np.argsort(whole, kind="stable")
            new[1:] = whole[order][1:] != whole[order][:-1]
        first = np.flatnonzero(new)
        which = np.empty(len(whole), dtype=np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(whole)))
        counts = np.concatenate([unpack(r["counts"]) for r in rows])[order]
        total = np.add.reduceat(counts, first)
        if named := rows[0]["least"] is not None:
            low = np.concatenate([unpack(r["least"]).view(np.int64) + r["base"] for r in rows])[order]
            least = np.minimum.reduceat(low, first)
            least[total == 1] = 0  # nobody needs it
        out, at = [], 0
        for r, k in zip(rows, keys, strict=True):
            w = which[at : at + len(k)]
            out.append({"block": r["block"], "step": step, "part": r["part"], "counts": pack(total[w]), "least": pack(least[w].view(np.uint64)) if named else None, "n": int((total[w] > 1).sum())})
            at += len(k)
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return asked.groupBy("part").applyInArrow(run, ANSWER)


class _File:
    """A column of records in a file that is read and written from front to back."""

    def __init__(self, dtype):
        self.dtype, self.file = np.dtype(dtype), tempfile.TemporaryFile()

    def write(self, a: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(a, dtype=self.dtype).tobytes())

    def chunks(self, size: int) -> Iterator[np.ndarray]:
        self.file.seek(0)
        while raw := self.file.read(size * self.dtype.itemsize):
            yield np.frombuffer(raw, dtype=self.dtype).copy()


class Collection:
    """Sorted suffixes of short strings: Burrows-Wheeler transform, owners and common prefixes, as sequential files.

    rows: the strings, aligned to the right in a matrix of symbols. Round j inserts the suffixes of length j. The place of
    a new suffix follows from its symbol's rank in the transform, which one pass over the file gives; a second pass
    writes the merged files, with the common prefix (at most `cap`) of each new suffix and its neighbours.
    """

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, cap: int, chunk: int):
        self.rows, self.lengths, self.cap, self.chunk = rows, lengths, cap, chunk
        self.count, self.width = rows.shape
        self.step = self.width + cap + 8  # rows end in so many zeros that 8 bytes can be read from any place
        padded = np.zeros(self.count * self.step + 8, dtype=np.uint8)
        padded[: self.count * self.step].reshape(self.count, -1)[:, : self.width] = rows
        self.words = np.zeros(self.count * self.step, dtype=np.uint64)  # the 8 bytes from each place on
        for k in range(8):
            self.words |= padded[k : k + len(self.words)].astype(np.uint64) << np.uint64(8 * k)
        self.symbols, self.owners, self.prefixes = _File(np.uint8), _File(np.uint32), _File(np.uint8)
        self.symbols.write(np.zeros(self.count))
        self.owners.write(np.arange(self.count, dtype=np.uint32) << SHIFT)  # owner, then the suffix's length
        self.prefixes.write(np.zeros(self.count))
        place = np.arange(self.count)
        for j in range(1, self.width + 1):
            active = np.flatnonzero(lengths >= j)
            symbol = rows[active, self.width - j].astype(np.int64) + 1
            place[active] = self._ranked(place[active], symbol)
            self._merge(place[active], active, j)
            # suffixes that are whole strings move up by what was inserted before them
            done = np.flatnonzero(lengths < j)
            if len(done):
                q = np.sort(place[active])
                place[done] += np.searchsorted(q - np.arange(len(q)), place[done], side="right")

    def _ranked(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Puts the symbols at their places in the transform; place of each new suffix in the merged order."""
        order = np.argsort(place)
        place, symbol = place[order], symbol[order]
        total, rank, base, fresh = np.zeros(256, dtype=np.int64), np.empty(len(place), dtype=np.int64), 0, _File(np.uint8)
        for part in self.symbols.chunks(self.chunk):
            a, b = np.searchsorted(place, [base, base + len(part)])
            at = place[a:b] - base
            part[at] = symbol[a:b]
            fresh.write(part)
            sizes = np.bincount(part, minlength=256)
            within = np.empty(len(part), dtype=np.int32)
            within[np.argsort(part, kind="stable")] = np.arange(len(part), dtype=np.int32)
            rank[a:b] = (total - np.cumsum(sizes) + sizes)[symbol[a:b]] + within[at]
            total += sizes
            base += len(part)
        self.symbols = fresh
        total[0] = self.count  # the empty suffixes come first
        out = np.empty_like(rank)
        out[order] = (np.cumsum(total) - total)[symbol] + rank
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, at most cap."""
        out, rest, done = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), 0
        owner_a, owner_b = (a >> SHIFT).astype(np.int64) * self.step, (b >> SHIFT).astype(np.int64) * self.step
        size_a, size_b = (a & LENGTH).astype(np.int64), (b & LENGTH).astype(np.int64)
        at_a, at_b, most = owner_a + self.width - size_a, owner_b + self.width - size_b, np.minimum(np.minimum(size_a, size_b), self.cap)
        while len(rest) and done < self.cap:
            other = self.words[at_a[rest] + done] ^ self.words[at_b[rest] + done]
            same = np.bitwise_count((other & -other) - np.uint64(1)).astype(np.int64) >> 3  # 8 if all are
            out[rest] = done + same
            done += 8
            rest = rest[(same == 8) & (most[rest] > done)]
        return np.minimum(out, most)

    def _merge(self, place: np.ndarray, owner: np.ndarray, length: int) -> None:
        order = np.argsort(place)
        place, owner = place[order], owner[order]
        before = place - np.arange(len(place))  # old records ahead of each new one
        record = (owner.astype(np.uint32) << SHIFT) | np.uint32(length)
        symbols, owners, prefixes = _File(np.uint8), _File(np.uint32), _File(np.uint8)
        base, a, ahead, late = 0, 0, None, False
        old = zip(self.symbols.chunks(self.chunk), self.owners.chunks(self.chunk), self.prefixes.chunks(self.chunk), strict=True)
        total = self.owners.file.seek(0, 2) // 4
        for sym, own, pre in old:
            end = base + len(own)
            b = np.searchsorted(before, end, side="left") if end < total else len(before)
            at = before[a:b] - base
            sym, own, pre = np.insert(sym, at, 0), np.insert(own, at, record[a:b]), np.insert(pre, at, 0)
            fresh = at + np.arange(b - a)
            redo = np.zeros(len(own) + 1, dtype=bool)  # the new ones and their next neighbours
            redo[fresh] = redo[fresh + 1] = True
            redo[0] |= late
            redo = np.flatnonzero(redo[:-1])
            left = np.concatenate([[ahead if ahead is not None else np.uint32(0)], own[:-1]])
            pre[redo] = self._common(left[redo], own[redo])
            if ahead is None:
                pre[0] = 0
            late, ahead = bool(len(fresh)) and fresh[-1] == len(own) - 1, own[-1]
            symbols.write(sym)
            owners.write(own)
            prefixes.write(pre)
            base, a = end, b
        self.symbols, self.owners, self.prefixes = symbols, owners, prefixes

    def equal(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, length and group of the suffixes of `least` or more symbols; a group shares its first `least` ones."""
        out, group, low = [], 0, LENGTH
        for own, pre in zip(self.owners.chunks(self.chunk), self.prefixes.chunks(self.chunk), strict=True):
            number = group + np.cumsum(pre < least)
            group = int(number[-1])
            long = (own & low) >= np.uint32(least)
            out.append(np.stack([(own[long] >> SHIFT).astype(np.int64), (own[long] & low).astype(np.int64), number[long]]))
        return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, dtype=np.int64),) * 3


def windows_elsewhere(strings: list[bytes], docs: np.ndarray, p: Params) -> np.ndarray:
    """Of each string a mask: bit k is set if the window at byte k is also in a string of a smaller document."""
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(s, len(number)) for s in strings), dtype=np.int64, count=len(strings))
    distinct = list(number)
    lengths = np.array([len(s) for s in distinct])
    width = int(lengths.max())
    rows = np.frombuffer(b"".join(s.rjust(width, b"\0") for s in distinct), dtype=np.uint8).reshape(-1, width)
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, which, docs)
    owner, length, group = Collection(rows, lengths, p.least, p.chunk).equal(p.least)
    names, group = np.unique(group, return_inverse=True)
    low = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(low, group, first[owner])
    best = np.full((len(distinct), p.span), np.iinfo(np.int64).max)
    best[owner, lengths[owner] - length] = low[group]
    bits = (best[which] < docs[:, None]).astype(np.uint64) << np.arange(p.span, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=1)


def compare(sent: DataFrame, p: Params) -> DataFrame:
    """Masks of the strings that blocks sent, in their order."""

    def run(t: pa.Table) -> pa.Table:
        rows, strings, docs = t.to_pylist(), [], []
        sizes = []
        for r in rows:
            raw, lengths = zstandard.ZstdDecompressor().decompress(r["strings"]), unpack(r["lengths"]).astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            strings += [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            docs.append(unpack(r["docs"]).view(np.int64))
            sizes.append(len(lengths))
        masks = np.split(windows_elsewhere(strings, np.concatenate(docs), p), np.cumsum(sizes)[:-1])
        out = [{"block": r["block"], "step": 4, "part": r["part"], "counts": pack(m), "least": None, "n": len(m)} for r, m in zip(rows, masks, strict=True)]
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return sent.groupBy("part").applyInArrow(run, ANSWER)


def dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_bytes, spans (start, stop of the maximal removed runs, in bytes), kept (the other bytes) for each row.

    docs: doc_id, text; other columns are ignored. A null text is empty; matches never cross documents, overlap freely,
    and are judged on the input. A row with null doc_id is smaller than none: it loses nothing and takes nothing. Rows that
    repeat a doc_id don't remove each other's bytes. Whole texts count, of any length; no rows give no rows.
    """
    coded = blocks(docs, p)
    total = coded.agg(F.coalesce(F.sum("n_anchors"), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / p.part_keys))

    def ask_anchors(batches):
        for b in batches:
            for row in b.to_pylist():
                own = Block(row, p)
                for r in own.ask(own.keys, own.doc, parts):
                    yield pa.RecordBatch.from_pylist([r], schema=_ASKED)

    first = written(answer(coded.mapInArrow(ask_anchors, ASKED), 1), "anchors")
    shared = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some = max(1, math.ceil(shared / p.part_keys))
    windows = max(1, math.ceil(shared * p.span / p.part_keys / 2))
    bits = min(64, max(16, (shared * p.span).bit_length() + 6))

    def told(block: pa.Table, answers: pa.Table) -> Iterator[tuple[dict, list[dict], bytes | None]]:
        """A block's row, what was answered to it last, and its state."""
        rows = answers.to_pylist()
        state = next((r["counts"] for r in rows if r["part"] == STATE), None)
        for row in block.to_pylist():
            yield row, [r for r in rows if r["part"] != STATE], state

    def ask_segments(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row, got, _ in told(block, answers):
            own = Block(row, p)
            own.learn_anchors(got)
            out += [*own.ask(own.segment_keys, own.doc, some, own.segment_checks), own.segment_state()]
        return pa.Table.from_pylist(out, schema=_ASKED)

    def ask_windows(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row, got, state in told(block, answers):
            own = Block(row, p, state)
            own.learn_segments(got)
            out += own.ask_windows(windows, bits)
        return pa.Table.from_pylist(out, schema=_ASKED)

    def with_blocks(answers: DataFrame, what, schema: str) -> DataFrame:
        return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(what, schema)

    def states(asked: DataFrame) -> DataFrame:
        none = F.lit(None).cast("binary").alias("least")
        return asked.filter(F.col("part") == STATE).select("block", F.lit(0).alias("step"), "part", F.col("state").alias("counts"), none, F.lit(0).cast("bigint").alias("n"))

    def answered(asked: DataFrame, step: int, label: str) -> DataFrame:
        return written(answer(asked.filter(F.col("part") != STATE), step), label)

    asked = written(with_blocks(first, ask_segments, ASKED), "segment_questions")
    forget(first)
    got = answered(asked, 2, "segments")
    asked_next = written(with_blocks(got.unionByName(states(asked)), ask_windows, ASKED), "window_questions")
    forget(asked, got)
    asked, got = asked_next, answered(asked_next, 3, "windows")
    many = max(1, math.ceil(shared / 3 / p.part_strings))

    def send(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row, got, state in told(block, answers):
            own = Block(row, p, state)
            own.learn_windows(got)
            out += own.send(many)
        return pa.Table.from_pylist(out, schema=_SENT)

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row, got, state in told(block, answers):
            out.append(Block(row, p, state).result(_joined(got, "counts") if got else np.zeros(0, dtype=np.uint64)))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], schema=_RESULT)

    sent = written(with_blocks(got.unionByName(states(asked)), send, SENT), "strings")
    forget(asked, got)
    masks = written(compare(sent.filter(F.col("part") != STATE), p), "suffixes")
    return with_blocks(masks.unionByName(states(sent)), finish, RESULT)
