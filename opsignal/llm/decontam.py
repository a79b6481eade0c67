"""Benchmark decontamination: SimHash of item-sized windows, an index of Hamming blocks, exact similarity of shingles."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal.llm.common import by_bytes
from xxhash import xxh64_intdigest

FACTOR = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, similarity double, hamming int, start_word int, windows int"


@dataclass(frozen=True)
class Params:
    """size: words of a shingle; similarity: least of a contaminated window; radius: most differing bits of 64; blocks:
    of the index; item_bytes: text of items that one pass over the documents holds; text_bytes: text of documents that is
    hashed at once."""

    size: int = 5
    similarity: float = 0.8
    radius: int = 19
    blocks: int = 4
    item_bytes: int = 8 << 20
    text_bytes: int = 2 << 20


#: Bytes of words: ASCII letters, digits and underscores, and all of characters beyond ASCII.
IN_WORD = np.array([c >= 128 or chr(c).isalnum() or chr(c) == "_" for c in range(256)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2 to the 64; as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grown(self, n: int) -> "_Powers":
        if len(self.up) < n:
            size = 1 << n.bit_length()
            for name, base in (("up", int(FACTOR)), ("down", pow(int(FACTOR), -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self


POWERS = _Powers()


def word_hashes(raw: bytes, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, from about `step` bytes at a time, never cut inside a word."""
    out, at, whole = [], 0, np.frombuffer(raw, dtype=np.uint8)
    while at < len(whole):
        stop, reach = len(whole), step
        while at + reach < len(whole):
            gaps = np.flatnonzero(~IN_WORD[whole[at : at + reach]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            reach *= 2
        part = whole[at:stop]
        inside = IN_WORD[part]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        p = POWERS.grown(len(part) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p.up[: len(part)], dtype=np.uint64, out=sums[1:])
            out.append((_mixed((sums[end] - sums[start]) * p.down[start]), start + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` word hashes; of the whole sequence if it is shorter; none of no words."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * FACTOR + words[k : len(words) - size + 1 + k]
        return _mixed(total + np.uint64(size))


def window_fingerprints(h: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each run of n shingles: a bit is 1 if over half of them have it."""
    bits = np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(h) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return np.packbits(2 * (sums[n:] - sums[:-n]) > n, axis=1, bitorder="little").view("<u8")[:, 0]


class HammingIndex:
    """Finds all pairs of a query and a stored fingerprint within the radius.

    Of `blocks` blocks of the 64 bits at least one differs in radius // blocks bits at most; so each distinct value of a
    block is compared with the stored blocks, and only fingerprints with such a block are compared in full.
    """

    def __init__(self, fps: np.ndarray, radius: int, blocks: int):
        self.fps, self.radius, self.near = fps, radius, radius // blocks
        self.width = 64 // blocks
        self.shifts = [np.uint64(self.width * i) for i in range(blocks)]
        self.low = np.uint64((1 << self.width) - 1)
        self.parts = [(fps >> s) & self.low for s in self.shifts]

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of query and stored fingerprint, and their distance."""
        out = []
        for k in range(0, len(queries), 4096):
            q = queries[k : k + 4096]
            close = np.zeros((len(q), len(self.fps)), dtype=bool)
            for s, part in zip(self.shifts, self.parts, strict=True):
                values, which = np.unique((q >> s) & self.low, return_inverse=True)
                close |= (np.bitwise_count(values[:, None] ^ part[None, :]) <= self.near)[which]
            a, b = np.nonzero(close)
            d = np.bitwise_count(q[a] ^ self.fps[b])
            ok = d <= self.radius
            out.append((a[ok] + k, b[ok], d[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


class Items:
    """A block of benchmark items, ready to be searched for. items: (item_id, text); those without words never match."""

    def __init__(self, items: list[tuple[int, str | None]], p: Params):
        self.p = p
        self.ids, self.shingles = [], []
        for i, text in items:
            h = self.hashes(text)
            if len(h):
                self.ids.append(i)
                self.shingles.append(h)
        self.counts = [Counter(h.tolist()) for h in self.shingles]
        whole = np.concatenate(self.shingles) if self.ids else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(self.ids)), [len(h) for h in self.shingles]) if self.ids else np.zeros(0, dtype=int)
        pairs = sorted(set(zip(whole.tolist(), owner.tolist(), strict=True)))
        self.known = np.unique(whole)
        self.owners: dict[int, list[int]] = defaultdict(list)
        for h, i in pairs:
            self.owners[h].append(i)
        bits = max(16, (64 * max(1, len(self.known))).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(self.known >> self.shift).astype(np.int64)] = True
        by_size = defaultdict(list)
        for i, h in enumerate(self.shingles):
            by_size[len(h)].append(i)
        self.by_size = {}
        for n, members in by_size.items():
            fps = np.array([window_fingerprints(self.shingles[i], n)[0] for i in members], dtype=np.uint64)
            self.by_size[n] = members, HammingIndex(fps, p.radius, p.blocks)

    def hashes(self, text: str | None) -> np.ndarray:
        words, _ = word_hashes((text or "").lower().encode("utf-8", "surrogatepass"), self.p.text_bytes)
        return shingle_hashes(words, self.p.size)

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard of the shingles, a shingle's weight being how often it occurs."""
        a, b = Counter(window.tolist()), self.counts[item]
        both = sum(min(c, b[h]) for h, c in a.items() if h in b)
        return both / (len(window) + len(self.shingles[item]) - both)

    def known_among(self, h: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        maybe = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        return maybe[np.isin(h[maybe], self.known)] if len(maybe) else maybe

    def search_all(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple]]]:
        """Number of each text that contains items, and what search() gives for it."""
        group, size = [], 0
        for n, text in enumerate(texts):
            raw = (text or "").lower().encode("utf-8", "surrogatepass")
            group.append((n, raw))
            size += len(raw) + 1
            if size >= self.p.text_bytes or n == len(texts) - 1:
                yield from self._search_group(group)
                group, size = [], 0

    def _search_group(self, group: list[tuple[int, bytes]]) -> Iterator[tuple[int, list[tuple]]]:
        words, at = word_hashes(b"\n".join(raw for _, raw in group), self.p.text_bytes)
        cuts = np.searchsorted(at, np.cumsum([0] + [len(raw) + 1 for _, raw in group]))
        begin, count = cuts[:-1], np.diff(cuts)
        for k in np.flatnonzero((count > 0) & (count < self.p.size)).tolist():  # the whole sequence is their shingle
            yield from ((group[k][0], found) for found in [self.search(shingle_hashes(words[begin[k] : cuts[k + 1]], self.p.size))] if found)
        if len(words) < self.p.size:
            return
        h = shingle_hashes(words, self.p.size)
        hits = self.known_among(h)
        owner = np.searchsorted(cuts, hits, side="right") - 1
        hits, owner = (x[hits + self.p.size <= cuts[owner + 1]] for x in (hits, owner))
        for k in np.unique(owner).tolist():
            if found := self.search(h[begin[k] : cuts[k + 1] - self.p.size + 1]):
                yield group[k][0], found

    def search(self, h: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(item_id, similarity, hamming, start_word, windows) of each item that a window of a text's shingles contains.

        Only windows that share a shingle with an item of their size are fingerprinted: no other can be similar.
        """
        hits = self.known_among(h)
        at: dict[int, list[int]] = defaultdict(list)
        for pos in hits.tolist():
            for n in {len(self.shingles[i]) for i in self.owners[int(h[pos])]}:
                at[n].append(pos)
        best: dict[int, tuple] = {}
        for n, positions in at.items():
            members, index = self.by_size[n]
            width = min(n, len(h))
            for start, end in _stretches(positions, width, len(h)):
                queries, stored, distance = index.search(window_fingerprints(h[start:end], width))
                for q, s, d in zip(queries.tolist(), stored.tolist(), distance.tolist(), strict=True):
                    item = members[s]
                    alike = self.similarity(h[start + q : start + q + width], item)
                    if alike >= self.p.similarity:
                        old = best.get(item)
                        new = (alike, -d, -(start + q))
                        best[item] = (max(old[0], new), old[1] + 1) if old else (new, 1)
        return [(self.ids[i], b[0], -b[1], -b[2], count) for i, (b, count) in sorted(best.items())]


def _stretches(positions: list[int], width: int, total: int, most: int = 1 << 14):
    """(start, end) of runs of shingles that cover all windows over the positions, each window in one run."""
    first, last = None, None  # of the window starts not yet given out
    for pos in positions:
        a, b = max(0, pos - width + 1), min(pos, total - width)
        if first is not None and (a > last + 1 or b - first >= most):
            yield first, last + width
            first, a = None, max(a, last + 1)
        if a <= b:
            first, last = (a if first is None else first), b
    if first is not None:
        yield first, last + width


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, item_id, similarity, hamming, start_word, windows: one row per row of docs and item that it contains.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are runs of letters, digits,
    underscores and characters beyond ASCII, in lower case; shingles have params.size words, in a text with fewer they are the whole sequence.
    A window has as many shingles as the item (all of a shorter text); it is contaminated if its fingerprint is within the
    radius and its weighted Jaccard similarity is params.similarity or more. similarity, hamming and start_word are of
    the most similar window (ties: nearer fingerprint, then earlier); windows: how many there are. Null and empty
    texts and items match nothing; equal items are all named; repeated rows each give their rows; clean documents give
    none; empty tables give none.

    The items are the query set. They go to all tasks in blocks of about params.item_bytes of text, with one pass over the
    documents for each block; documents are not shuffled.
    """
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // params.item_bytes))
    out = None
    for k in range(passes):
        rows = benchmark.select("item_id", "text").filter("text is not null")
        rows = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else rows
        sent = spark.sparkContext.broadcast(sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))

        def run(batches, sent=sent):
            items = Items(sent.value, params)
            for b in by_bytes(batches):
                ids = b.column(0).to_pylist()
                found = [(ids[n], *f) for n, own in items.search_all(b.column(1).to_pylist()) for f in own]
                if found:
                    columns = zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["doc_id", "item_id", "similarity", "hamming", "start_word", "windows"])

        part = docs.select("doc_id", "text").mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out
