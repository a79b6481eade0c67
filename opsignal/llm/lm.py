"""Language-model scores by deleted interpolation of word bigrams, word counts and the uniform distribution.

P(w | v) = a2 * c(v, w) / c(v) + a1 * c(w) / N + a0 / (V + 1). The mixture weights a depend on how often the context v was
seen (classes of powers of two) and are learned by expectation-maximisation on a deleted part of the training
documents, with the counts of the rest.

Counts never meet in one place. Documents are coded in blocks of bounded size. Each block sends its distinct words and
bigrams, as sorted 64-bit hashes with their counts, to parts of the hash range; a part adds them up and answers each
block in the order that it asked. A block then scores its documents with the answers. So what is shuffled are packed
arrays, and a frequent word or a hot source costs one entry per block.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from opsignal.llm.common import written

BLOCK = "block long, deleted boolean, ids array<long>, held array<boolean>, lengths binary, words binary, tokens binary, n_tokens long, n_words long, n_train long, n_train_deleted long"
ASKED = "block long, deleted boolean, part int, keys binary, n binary, d binary"
ANSWER = "block long, deleted boolean, part int, n binary, d binary, words long"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
START, END = 0, 1  # numbers of the marks in each block's list of words
CLASSES = 64


@dataclass(frozen=True)
class Params:
    """mod, held, deleted: of crc32 of doc_id as text, the remainder of documents that are never learned from and of those
    that the weights are learned on; rounds: of expectation-maximisation; block_tokens: about the size of a block;
    part_keys: about the entries that one part adds up."""

    mod: int = 7
    held: int = 2
    deleted: int = 3
    rounds: int = 15
    block_tokens: int = 2_000_000
    part_keys: int = 2_000_000


@dataclass(frozen=True)
class Sizes:
    tokens: int  # N: tokens of all training documents
    deleted: int  # those of the deleted part
    words: int  # V: distinct training tokens


def pack(a: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte place, compressed."""
    planes = np.ascontiguousarray(a.astype(np.uint64, copy=False)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64)[:, 0]


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(raw), dtype=np.uint64)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bigram_keys(words: np.ndarray, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words[before] * np.uint64(0x9E3779B97F4A7C15) + words[tokens]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Open:
    """A block that is being filled."""

    def __init__(self, deleted: bool):
        self.deleted, self.number = deleted, defaultdict(count(2).__next__)
        self.ids, self.held, self.lengths, self.parts, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, held: bool, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words)))
        self.parts.append(np.array([END]))
        self.ids.append(doc_id)
        self.held.append(held)
        self.lengths.append(len(words) + 1)
        self.size += len(words) + 1

    def row(self) -> dict:
        tokens = np.concatenate(self.parts)
        hashes = np.array([xxh64_intdigest(m, seed=1) for m in (b"start", b"end")] + [xxh64_intdigest(w, seed=0) for w in self.number], dtype=np.uint64)
        often = np.bincount(tokens, minlength=len(hashes))
        order = np.concatenate([[START, END], 2 + np.argsort(-often[2:], kind="stable")])  # frequent words get small numbers
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        train = self.size if self.deleted else int(sum(n for n, h in zip(self.lengths, self.held, strict=True) if not h))
        return {
            "block": uuid.uuid4().int >> 65, "deleted": self.deleted, "ids": self.ids, "held": self.held,
            "lengths": pack(np.array(self.lengths)), "words": hashes[order].tobytes(), "tokens": pack(place[tokens]),
            "n_tokens": self.size, "n_words": len(hashes), "n_train": train, "n_train_deleted": train if self.deleted else 0,
        }


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("deleted", pa.bool_()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary()),
    ("words", pa.binary()), ("tokens", pa.binary()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("n_train", pa.int64()), ("n_train_deleted", pa.int64()),
])
ASKED_ARROW = pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), ("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("d", pa.binary())])


def blocks(docs: DataFrame, p: Params) -> DataFrame:
    """Documents coded in blocks; those of the deleted part have blocks of their own."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(p.mod))
    rows = docs.select("doc_id", "text", F.coalesce(remainder, F.lit(p.held)).cast("int").alias("kind"))

    def run(batches):
        filling = {k: _Open(k) for k in (False, True)}
        for b in batches:
            for doc_id, text, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                deleted = kind == p.deleted
                filling[deleted].add(doc_id, kind == p.held, tokens_of(text))
                if filling[deleted].size >= p.block_tokens:
                    yield _arrow([filling[deleted].row()], BLOCK_ARROW)
                    filling[deleted] = _Open(deleted)
        for x in filling.values():
            if x.size:
                yield _arrow([x.row()], BLOCK_ARROW)

    return rows.mapInArrow(run, BLOCK)


class Block:
    """A coded block, and the order in which it asks for words and bigrams."""

    def __init__(self, row: dict):
        self.row = row
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.words = np.frombuffer(row["words"], dtype=np.uint64)
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        self.before = np.concatenate([[START], self.tokens[:-1]])
        self.before[self.begins] = START
        self.held = np.array(row["held"], dtype=bool)
        self.train = np.repeat(~self.held, self.lengths)
        self.word_order = np.argsort(self.words, kind="stable")
        self.keys, self.which = np.unique(bigram_keys(self.words, self.before, self.tokens), return_inverse=True)

    def asked(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted keys with training counts: of words (the start mark counts documents), then of bigrams."""
        n = np.bincount(self.tokens[self.train], minlength=len(self.words))
        n[START] = (~self.held).sum()
        yield self.words[self.word_order], n[self.word_order]
        yield self.keys, np.bincount(self.which[self.train], minlength=len(self.keys))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def ask(coded: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """Keys and counts of each block, one row for each part of the words' and of the bigrams' hash range."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                own, first = Block(row), 0
                for (keys, n), size in zip(own.asked(), parts, strict=True):
                    cuts = np.searchsorted(_part(keys, size), np.arange(size + 1))
                    for k in range(size):
                        s = slice(cuts[k], cuts[k + 1])
                        if cuts[k] < cuts[k + 1]:
                            packed = pack(n[s])
                            yield _arrow([{"block": row["block"], "deleted": row["deleted"], "part": first + k, "keys": pack_sorted(keys[s]), "n": packed, "d": packed if row["deleted"] else None}], ASKED_ARROW)
                    first += size

    return coded.mapInArrow(run, ASKED)


def answer(asked: DataFrame, word_parts: int) -> DataFrame:
    """Totals of all blocks for each key that a block asked for, in its order; words: on one row of a part of words, how
    many have a training count."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        sizes = [len(k) for k in keys]
        known, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([unpack(r["n"]) for r in rows]).astype(np.float64)
        d = np.concatenate([np.zeros(s) if r["d"] is None else unpack(r["d"]) for r, s in zip(rows, sizes, strict=True)])
        total_n = np.bincount(which, weights=n, minlength=len(known))
        total_d = np.bincount(which, weights=d, minlength=len(known))
        start = np.uint64(xxh64_intdigest(b"start", seed=1))
        words = int((total_n > 0).sum() - (total_n[known == start] > 0).sum()) if rows[0]["part"] < word_parts else 0
        out, at = [], 0
        for r, s in zip(rows, sizes, strict=True):
            w = which[at : at + s]
            out.append({"block": r["block"], "deleted": r["deleted"], "part": r["part"], "n": pack(total_n[w]), "d": pack(total_d[w]), "words": words if not at else 0})
            at += s
        schema = pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), ("part", pa.int32()), ("n", pa.binary()), ("d", pa.binary()), ("words", pa.int64())])
        return pa.Table.from_pylist(out, schema=schema)

    return asked.groupBy("part").applyInArrow(run, ANSWER)


def _counts(own: Block, answers: pa.Table, word_parts: int) -> tuple[np.ndarray, ...]:
    """n and d of each word of the block, then of each of its bigrams."""
    rows = sorted(answers.to_pylist(), key=lambda r: r["part"])
    out = []
    for of_words in (True, False):
        these = [r for r in rows if (r["part"] < word_parts) == of_words]
        for name in ("n", "d"):
            whole = np.concatenate([unpack(r[name]) for r in these]).astype(np.float64)
            if of_words:
                placed = np.empty_like(whole)
                placed[own.word_order] = whole
                whole = placed
            out.append(whole)
    return tuple(out)


def context_class(c: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the binary logarithm of the count, rounded down."""
    return np.where(c > 0, np.frexp(np.maximum(c, 1))[1], 0)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=np.broadcast_to(b, a.shape) > 0)


def held_out_events(coded: DataFrame, answers: DataFrame, word_parts: int) -> DataFrame:
    """Of each block of the deleted part: how often each (c(v, w), c(v), c(w)) of the rest's counts comes up in it."""

    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            own = Block(row)
            n, d, n2, d2 = _counts(own, got, word_parts)
            events = np.stack([(n2 - d2)[own.which], (n - d)[own.before], (n - d)[own.tokens]])
            events = events[:, np.lexsort(events)]
            first = np.flatnonzero(np.concatenate([[True], (events[:, 1:] != events[:, :-1]).any(axis=0)]))
            out.append({"pair": pack(events[0][first]), "context": pack(events[1][first]), "word": pack(events[2][first]), "times": pack(np.diff(first, append=events.shape[1]))})
        return pa.Table.from_pylist(out, schema=pa.schema([(k, pa.binary()) for k in ("pair", "context", "word", "times")]))

    left, right = coded.filter("deleted").groupBy("block"), answers.filter("deleted").groupBy("block")
    return left.cogroup(right).applyInArrow(run, "pair binary, context binary, word binary, times binary")


def learn(events: DataFrame, sizes: Sizes, rounds: int) -> np.ndarray:
    """Mixture weights (bigram, word, uniform) of each class of contexts, by expectation-maximisation.

    A class that the events don't have gets the weights of the next lower one that they have; without events all
    weights are a third.
    """
    weights = np.full((CLASSES, 3), 1 / 3)
    weights[0] = 0.0, 0.5, 0.5  # a context never seen has no bigram estimate
    rest, uniform = sizes.tokens - sizes.deleted, 1 / (sizes.words + 1)

    def expected(now: np.ndarray):
        def run(batches):
            total = np.zeros((CLASSES, 3))
            for b in batches:
                for row in b.to_pylist():
                    pair, context, word, times = (unpack(row[k]).astype(np.float64) for k in ("pair", "context", "word", "times"))
                    kind = context_class(context)
                    share = now[kind] * np.stack([_ratio(pair, context), word / max(rest, 1), np.full(len(pair), uniform)], axis=1)
                    share *= (times / share.sum(axis=1))[:, None]
                    for k in range(3):
                        total[:, k] += np.bincount(kind, weights=share[:, k], minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), *(pa.array(total[:, k]) for k in range(3))], names=["kind", "a2", "a1", "a0"])

        sums = events.mapInArrow(run, "kind int, a2 double, a1 double, a0 double").groupBy("kind").agg(*(F.sum(a).alias(a) for a in ("a2", "a1", "a0")))
        out = np.zeros((CLASSES, 3))
        for r in sums.collect():  # CLASSES rows
            out[r["kind"]] = r["a2"], r["a1"], r["a0"]
        return out

    for _ in range(rounds):
        got = expected(weights)
        seen = got.sum(axis=1) > 0
        if not seen.any():
            break
        new = (got + 1e-4) / (got.sum(axis=1, keepdims=True) + 3e-4)
        change = np.abs(new - weights)[seen].max()
        weights[seen] = new[seen]
        if change < 1e-5:
            break
    else:
        seen = got.sum(axis=1) > 0 if rounds else np.zeros(CLASSES, bool)
    for k in range(2, CLASSES):
        if rounds and not seen[k]:
            weights[k] = weights[k - 1]
    return weights


def score(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Words are what ASCII white space divides, A-Z in lower case; each text ends with one end token. A null text is
    empty: its only token is the end. held_out: crc32 of doc_id as text has remainder p.held; a null doc_id counts as
    held out. Nothing is learned from held-out documents. base_score: sum of log10((c + 1) / (N + V + 1)); score: log10
    probability under the interpolated model. Repeated rows count and are scored each; other columns are ignored. Without
    training documents N and V are 0 and the score is that of the uniform distribution. No rows give no rows.
    """
    coded = written(blocks(docs, p), "blocks")
    s = coded.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_words", "n_train", "n_train_deleted"))).first()
    parts = max(1, math.ceil(s["n_words"] / p.part_keys)), max(1, math.ceil(s["n_tokens"] / p.part_keys))
    answers = written(answer(ask(coded, parts), parts[0]), "answers")
    sizes = Sizes(s["n_train"], s["n_train_deleted"], answers.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    weights = learn(written(held_out_events(coded, answers, parts[0]), "events"), sizes, p.rounds)

    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            own = Block(row)
            n, _, n2, _ = _counts(own, got, parts[0])
            c, context = n[own.tokens], n[own.before]
            a = weights[context_class(context)]
            chance = a[:, 0] * _ratio(n2[own.which], context) + a[:, 1] * c / max(sizes.tokens, 1) + a[:, 2] / (sizes.words + 1)
            if not sizes.tokens:
                chance = np.full(len(c), 1 / (sizes.words + 1))
            rows = len(own.lengths)
            columns = [
                pa.array(row["ids"], pa.int64()), pa.array(own.held), pa.array(own.lengths), pa.array(np.add.reduceat((c > 0).astype(np.int64), own.begins)),
                pa.array(np.full(rows, sizes.tokens, dtype=np.int64)), pa.array(np.add.reduceat(np.log10((c + 1) / (sizes.tokens + sizes.words + 1)), own.begins)),
                pa.array(np.add.reduceat(np.log10(chance), own.begins)),
            ]
            out.append(pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        if out:
            return pa.concat_tables(out)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORE)
