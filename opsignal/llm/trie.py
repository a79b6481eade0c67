"""Prefix trie of conversations: who shares which first turns, and how many words that saves.

Turns are dictionary-encoded, the sequences of ids are dealt by ranges, and each range shard builds a ternary search
tree of its sequences. Nodes whose sequence starts in one shard alone are final; those on the border paths, which
neighbouring shards share, are merged by sums that a node's part in each shard adds to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsignal.llm.common import session_parallelism, written
from opsignal.llm.ordered import hashed_in_order, joined, numbered, turn_digest, word_count

NO_ENDS = hashlib.sha256(b"").hexdigest()
CHUNK = 500
BLOCK = 20
NODE = (
    "shard int, edge boolean, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends array<string>, ends_sha256 string"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@dataclass(frozen=True)
class Params:
    """shard_turns: about how many ids and conversations one shard's tree is built of."""

    shard_turns: int = 400_000


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, digest, words, at (place in the conversation) of each row of rows (conv_id, turn, role, text).

    A null role or text is empty. Order: turn, nulls first; rows of one turn by the digest of role and text. Rows without
    conv_id belong to no conversation and are left out. Texts stay where they are, only their digests are sorted.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", turn_digest(role, text).alias("digest"), word_count(text).alias("words"))
    return numbered(plain, "conv_id", ["turn", "digest"], "turns").select("conv_id", "digest", "words", "at")


def borrowed(conv_id):
    """How many turns a conversation takes from its block's first one: unsigned crc32(decimal conv_id) % 4."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(placed: DataFrame) -> DataFrame:
    """conv_id, pos, digest, words: each conversation c of turns() as the first h turns of conversation c - c % 20, then its own beyond h.

    pos orders the turns, with gaps; one row with pos 0 and null digest stands before each conversation's turns, so that
    a conversation without turns is kept. Each first conversation gives 3 turns to less than 40 others.
    """
    convs = placed.filter("at = 1").select("conv_id", borrowed(F.col("conv_id")).alias("h"))
    heads = placed.filter((F.col("at") <= 3) & (F.col("conv_id") % BLOCK == 0)).select(F.col("conv_id").alias("of"), "at", "digest", "words")
    taken = convs.withColumn("of", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "of").filter("at <= h")
    own = placed.filter(F.col("at") > borrowed(F.col("conv_id")))
    base = convs.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("words"))
    return base.unionByName(taken.select("conv_id", F.col("at").alias("pos"), "digest", "words")).unionByName(
        own.select("conv_id", F.col("at").alias("pos"), "digest", "words")
    )


class TernaryTree:
    """A ternary search tree over sequences of ids, inserted median first, so that each level's searches are balanced.

    Node 0 is the root's textless node. under: of each node the top of the search tree of its children.
    """

    def __init__(self):
        self.id, self.words, self.low, self.high, self.under, self.parent, self.depth = [0], [0], [-1], [-1], [-1], [-1], [0]

    def _new(self, i: int, words: int, parent: int) -> int:
        self.id.append(i)
        self.words.append(words)
        self.low.append(-1)
        self.high.append(-1)
        self.under.append(-1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.id) - 1

    def insert(self, ids: list[int], words: list[int]) -> int:
        """The node of the whole sequence."""
        at, symbol, low, high = 0, self.id, self.low, self.high
        for i, w in zip(ids, words, strict=True):
            node = self.under[at]
            if node < 0:
                node = self.under[at] = self._new(i, w, at)
            while symbol[node] != i:
                side = low if i < symbol[node] else high
                if side[node] < 0:
                    side[node] = self._new(i, w, at)
                node = side[node]
            at = node
        return at

    def path(self, ids: list[int]) -> Iterator[int]:
        """Nodes of the sequence's prefixes, the textless one first."""
        at = 0
        yield at
        for i in ids:
            at = self.under[at]
            while self.id[at] != i:
                at = self.low[at] if i < self.id[at] else self.high[at]
            yield at


def medians(n: int) -> Iterator[int]:
    """0 to n-1, the middle of each range before its halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(a, m), (m + 1, b)]


def chunked(ids: list[int]) -> list[str]:
    return [",".join(map(str, ids[k : k + CHUNK])) for k in range(0, len(ids), CHUNK)]


def shard_nodes(t: pa.Table) -> pa.Table:
    """Nodes of one shard. Border nodes are marked `edge` and hold this shard's part of each sum."""
    shard, ahead, after = (t[k][0].as_py() for k in ("shard", "ahead", "after"))
    rows = sorted(zip(*(t[k].to_pylist() for k in ("ids", "tail", "conv_id", "tail_last", "words")), strict=True))
    sequences: list[tuple[list[int], list[int]]] = []
    ends: list[list[int]] = []
    tails: list[list[tuple[int, bool]]] = []
    for ids, tail, conv, tail_last, words in rows:
        if not sequences or sequences[-1][0] != ids:
            sequences.append((ids, words))
            ends.append([])
            tails.append([])
        if tail:
            tails[-1].append((conv, tail_last))
        else:
            ends[-1].append(conv)
    tree, at = TernaryTree(), [0] * len(sequences)
    for k in medians(len(sequences)):
        at[k] = tree.insert(*sequences[k])
    n = len(tree.id)
    first, last = list(tree.path(sequences[0][0][: max(0, ahead)])), list(tree.path(sequences[-1][0][: max(0, after)]))
    foreign = set(first) if ahead >= 0 else set()  # the shard before counts their words and names them as children
    keys: dict[int, bytes] = {}
    for nodes in (first, last):
        h = hashlib.sha256()
        for node in nodes:
            if node:
                h.update(tree.id[node].to_bytes(8, "big"))
            keys[node] = h.copy().digest()

    members, least, leaves, saved, children = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    own = {}
    for k, node in enumerate(at):
        own[node] = k
        mine = ends[k] + [c for c, _ in tails[k]]
        members[node], least[node] = len(mine), min(mine)
        leaves[node], children[node] = len(tails[k]), len(tails[k])
        goes_on = tails[k] or tree.under[node] >= 0 or (k == len(at) - 1 and after == len(sequences[k][0]))
        leaves[node] += not goes_on
    for node in range(n - 1, -1, -1):  # a node's number is larger than its parent's
        saved[node] += members[node] * tree.words[node] - (0 if node in foreign else tree.words[node])
        p = tree.parent[node]
        if p >= 0:
            members[p] += members[node]
            least[p] = least[node] if least[p] is None else min(least[p], least[node])
            leaves[p] += leaves[node]
            saved[p] += saved[node]
            children[p] += node not in foreign

    out = []
    for node in range(n):
        k, p, edge = own.get(node), tree.parent[node], node in keys
        mine = ends[k] if k is not None else []
        above = keys.get(p) if p >= 0 else None
        out.append((
            shard, edge, keys.get(node), above, least[node], tree.depth[node], least[p] if p >= 0 and above is None else None, members[node],
            children[node], leaves[node], saved[node], chunked(mine) if edge else None,
            None if edge else hashlib.sha256(",".join(map(str, mine)).encode()).hexdigest(),
        ))
        for conv, ended in tails[k] if k is not None else ():
            out.append((
                shard, False, None, keys.get(node), conv, tree.depth[node] + 1, None if edge else least[node], 1, 0 if ended else 1, 1, 0, None,
                hashlib.sha256(str(conv).encode()).hexdigest() if ended else NO_ENDS,
            ))
    return pa.table(dict(zip(SCHEMA.names, zip(*out, strict=True), strict=True)), schema=SCHEMA)


SCHEMA = pa.schema([
    ("shard", pa.int32()), ("edge", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends", pa.list_(pa.string())), ("ends_sha256", pa.string()),
])


def shared_length(a: str, b: str) -> F.Column:
    """How many first elements two arrays share."""
    unlike = F.expr(f"array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false)")
    return F.when(unlike > 0, unlike - 1).otherwise(F.size(a))


def nodes(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv_id, pos, digest, words: the turns of each conversation in the order of pos, and before them a row with null
    digest. Equal digests are equal turns. conv_id: the smallest member, parent_conv_id: the parent's (null at the root);
    ends_sha256: SHA-256 (hex) of the decimal ids of the members that end here, ascending, comma-joined. No rows give no nodes.

    A turn that comes once in all conversations can't be shared, nor can what follows it: such a tail is a chain of nodes
    with one member and never leaves its rows. Only what is before it is gathered: 8 bytes an id, one array a conversation.
    Copies of a conversation may lie in several shards; so may the children of one node.
    """
    spark = rows.sparkSession
    rows = written(rows, "rebuilt")
    known = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    dictionary = written(known.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = joined(rows.filter("digest IS NOT NULL"), dictionary, ["digest"], "n", rows.count()).select("conv_id", "pos", "words", "id")
    coded = coded.unionByName(rows.filter("digest IS NULL").select("conv_id", "pos", "words", F.lit(-1).cast("bigint").alias("id")))
    laid = numbered(coded, "conv_id", ["pos"], "coded", mark=F.col("id").isNull()).withColumn("depth", F.col("at") - 1)

    chains = laid.filter("before").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    shared = F.col("id") >= 0
    heads = laid.filter(~F.col("before")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(shared, F.struct("at", "id", "words")))).alias("seq"),
        F.bool_or(F.col("id").isNull()).alias("tail"), F.bool_or(F.col("id").isNull() & F.col("last")).alias("tail_last"),
    )
    heads = written(heads.select("conv_id", F.col("seq.id").alias("ids"), F.col("seq.words").alias("words"), "tail", "tail_last"), "heads")
    size = heads.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    parts = max(1, -(-size // params.shard_turns), min(session_parallelism(spark), size // 2000))
    shards = written(heads.repartitionByRange(parts, "ids", "tail", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    order = Window.orderBy("shard")  # one row a shard
    borders = shards.groupBy("shard").agg(F.min("ids").alias("a"), F.max("ids").alias("z"))
    borders = borders.select("shard", "a", "z", F.lag("z").over(order).alias("z_before"), F.lead("a").over(order).alias("a_after")).select(
        "shard", F.when(F.col("z_before").isNull(), -1).otherwise(shared_length("z_before", "a")).alias("ahead"),
        F.when(F.col("a_after").isNull(), -1).otherwise(shared_length("z", "a_after")).alias("after"),
    )
    found = written(shards.join(F.broadcast(borders), "shard").groupBy("shard").applyInArrow(lambda t: shard_nodes(t), NODE), "nodes")

    edges = found.filter("edge")
    merged = edges.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    chunks = edges.select("key", "shard", F.posexplode("ends").alias("k", "ids"))
    merged = merged.join(hashed_in_order(chunks, "key", ["shard", "k"], "ids"), "key", "left")
    merged = written(merged.select("*", F.coalesce("sha256", F.lit(NO_ENDS)).alias("ends_sha256")).drop("sha256"), "borders")
    name = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    borders_out = merged.join(name, "parent_key", "left").select(*COLUMNS)
    inner = found.filter("NOT edge")
    above = edges.select("shard", F.col("key").alias("parent_key")).join(name, "parent_key")
    below = inner.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(above, ["shard", "parent_key"])
    return (
        inner.filter("parent_key IS NULL").select(*COLUMNS).unionByName(below.select(*COLUMNS))
        .unionByName(borders_out).unionByName(chains.select(*COLUMNS))
    )
