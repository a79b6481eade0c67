"""Repair of conversation structure: the cheapest edits that give a legal order of roles.

A row is one symbol (role and fault). Re-Pair rules, counted over all conversations, shorten the symbol strings; each
rule has one min-plus transfer matrix over the role machine's states whose entries carry cost and audit (the edits, as a
rope), made once from its two parts and used for every conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal.llm.common import written
from opsignal.llm.ordered import joined, turn_digest

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # the role that an inserted or reroled row takes
LAST = (START, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}

#: Symbols: a row that must go, then role initial (s, u, a, any other) with or without the fault `truncated`.
MUST_GO = 0
INITIALS = "sua"
FIRST_RULE = 1 + 2 * (len(INITIALS) + 1)
CUT = np.uint16(0xFFFF)


@dataclass(frozen=True)
class Params:
    """rules: most Re-Pair rules; rounds: most passes that count pairs; rules_a_round: most rules of a pass; chunk: symbols
    of a conversation in one row. None of these changes a result: what no rule covers is multiplied symbol by symbol.
    """

    rules: int = 512
    rounds: int = 5
    rules_a_round: int = 128
    chunk: int = 4096


def symbol(initial: str, truncated: bool) -> int:
    return 1 + 2 * (INITIALS.index(initial) if initial and initial in INITIALS else len(INITIALS)) + truncated


class Rope:
    """A string as a tree of parts that other ropes share."""

    __slots__ = ("left", "right", "size")
    FLAT = 64

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, size_of(left) + size_of(right)


def size_of(rope) -> int:
    return len(rope) if isinstance(rope, str) else rope.size


def join(a, b):
    if not size_of(a):
        return b
    if not size_of(b):
        return a
    return text_of(a) + text_of(b) if size_of(a) + size_of(b) <= Rope.FLAT else Rope(a, b)


def leaves(rope) -> Iterator[str]:
    todo = [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            yield r
        else:
            todo += [r.right, r.left]


def text_of(rope) -> str:
    return rope if isinstance(rope, str) else "".join(leaves(rope))


def compare(a, b) -> int:
    """Order of two ropes by their characters. Parts that both share at the same place aren't looked into."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, str) and isinstance(y, str):
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return -1 if x < y else 1
            left += [x[n:]] if len(x) > n else []
            right += [y[n:]] if len(y) > n else []
        elif isinstance(y, str) or not isinstance(x, str) and x.size >= y.size:
            left += [x.right, x.left]
            right.append(y)
        else:
            left.append(x)
            right += [y.right, y.left]
    return bool(left) - bool(right)


def better(a, b):
    """The cheaper of two (cost, audit), of equal costs the least audit; None is no way."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if compare(a[1], b[1]) <= 0 else b


def product(a: list, b: list) -> list:
    """Min-plus product of two matrices, rows first, of as many rows as a has.

    Equally cheap audits of the same rows are never a part of one another (a longer one has one more insert), so the
    least of joined audits is joined of the least.
    """
    out = []
    for row in range(len(a)):
        line = []
        for to in range(STATES):
            best = None
            for by in range(STATES):
                x, y = a[row][by], b[by][to]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    best = better(best, (x[0] + y[0], join(x[1], y[1])))
            line.append(best)
        out.append(line)
    return out


def inserts() -> list:
    """Matrix of inserted rows alone; more than two in a row lead where fewer do."""
    one = [[None] * STATES for _ in range(STATES)]
    for s in range(STATES):
        one[s][s] = (0, "")
    step = [[None] * STATES for _ in range(STATES)]
    for s in range(STATES):
        step[s][MOVES[s, NEXT[s]]] = (INSERT_COST, INSERT)
    total, run = one, one
    for _ in range(2):
        run = product(run, step)
        total = [[better(x, y) for x, y in zip(p, q, strict=True)] for p, q in zip(total, run, strict=True)]
    return total


INSERTS = inserts()


def terminal(k: int) -> list:
    """Matrix of one row: any inserts, then its edit."""
    edit: list = [[None] * STATES for _ in range(STATES)]
    for s in range(STATES):
        edit[s][s] = (DELETE_COST, DELETE)
        if k != MUST_GO:
            more = TRUNCATED_COST if (k - 1) % 2 else 0
            initial = (INITIALS + "-")[(k - 1) // 2]
            to = MOVES[s, NEXT[s]]
            edit[s][to] = better(edit[s][to], (REROLE_COST + more, REROLE))
            if (s, initial) in MOVES:
                to = MOVES[s, initial]
                edit[s][to] = better(edit[s][to], (KEEP_COST + more, KEEP))
    return product(INSERTS, edit)


def matrices(rules: list[tuple[int, int]]) -> list:
    """One matrix per symbol and rule, from the parts of each."""
    out = [terminal(k) for k in range(FIRST_RULE)]
    for a, b in rules:
        out.append(product(out[a], out[b]))
    return out


def apply_rule(s: np.ndarray, a: int, b: int, to: int) -> np.ndarray:
    """Each pair (a, b), from the left, becomes `to`."""
    at = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
    if not len(at):
        return s
    if a == b:  # of a run of equal symbols every second pair
        start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
    s = s.copy()
    s[at] = to
    return np.delete(s, at + 1)


def shortened(strings: list[bytes], rules: list[tuple[int, int]]) -> list[np.ndarray]:
    """The symbol strings after all rules in their order."""
    s = np.frombuffer(b"".join(x + CUT.tobytes() for x in strings), dtype=np.uint16)
    for k, (a, b) in enumerate(rules):
        s = apply_rule(s, a, b, FIRST_RULE + k)
    ends = np.flatnonzero(s == CUT)
    return [s[i + 1 : j] for i, j in zip(np.concatenate([[-1], ends[:-1]]), ends, strict=True)] if len(ends) else []


def grammar(strings: DataFrame, params: Params = Params()) -> list[tuple[int, int]]:
    """Re-Pair rules from all strings (symbols, n: how often each comes). Each pass counts the pairs that are left.

    At most (symbols + rules) squared pairs are counted, rules_a_round of them come to the driver.
    """
    rules: list[tuple[int, int]] = []
    for _ in range(params.rounds):
        room = min(params.rules_a_round, params.rules - len(rules))
        if room <= 0:
            break

        def count(batches, rules=tuple(rules)):
            total = np.zeros((FIRST_RULE + len(rules)) ** 2, dtype=np.int64)
            for b in batches:
                for s, n in zip(shortened(b.column(0).to_pylist(), list(rules)), b.column(1).to_pylist(), strict=True):
                    np.add.at(total, s[:-1].astype(np.int64) * (FIRST_RULE + len(rules)) + s[1:], n)
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["pair", "n"])

        pairs = strings.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
        found = pairs.orderBy(F.desc("n"), "pair").limit(room).collect()
        if not found:
            break
        rules += [divmod(r["pair"], FIRST_RULE + len(rules)) for r in found]
    return rules


def damaged(rows: DataFrame) -> DataFrame:
    """key, turn, role, text, n of rows (conv_id, turn, role, text) after damage; n: how often the row stands there.

    By crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes it a
    user's. A null role, text, conv_id or turn is one space in this; key names the conversation, `` if it has no id.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("n"), kind.alias("kind"),
    ).filter("kind <> 0").drop("kind")


def faults(rows: DataFrame) -> DataFrame:
    """key, turn, digest, initial, blank, truncated, again, n: one row per different row of damaged rows, written.

    again: an earlier turn has the same role and text. Equal rows of one turn are one row that stands n times.
    """
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    light = rows.select(
        "key", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.substring("role", 1, 1).alias("initial"),
        (end == "").alias("blank"), (~end.isin("", ".", "!", "?")).alias("truncated"), "n",
    )
    merged = light.groupBy("key", "turn", "digest").agg(
        F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.sum("n").alias("n")
    )
    merged = written(merged, "damaged")
    place = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    twice = merged.groupBy("key", "digest").agg(F.min(place).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    marked = joined(merged, written(twice, "repeated"), ["key", "digest"], "rows", merged.count())
    again = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return marked.select("key", "turn", "digest", "initial", "blank", "truncated", again.alias("again"), "n")


PIECE = (
    "key string, part int, k int, symbols binary, rows long, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, turns long, first_turn long, last_turn long"
)
LEGAL = ("su", "ua", "au")


def pieces(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """Each conversation's rows of faults() in their order, as pieces (key, part, k) of at most params.chunk symbols, written.

    Rows are dealt by ranges, so a conversation of any size is spread over tasks; nothing reaches beyond one piece.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        now, k, piece = None, 0, None

        def done():
            return (now, part, k, np.array(piece["symbols"], dtype=np.uint16).tobytes(), len(piece["symbols"]), *(piece[c] for c in COUNTS),
                    piece["first"], piece["last"], piece["turns"], piece["low"], piece["high"])

        out = []
        for b in batches:
            for key, turn, initial, blank, truncated, again, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if piece is None or key != now:
                    if piece is not None:
                        out.append(done())
                    now, k, piece = key, 0, _piece()
                fresh = True
                left = n
                while left:
                    if len(piece["symbols"]) >= params.chunk:
                        out.append(done())
                        k, piece = k + 1, _piece()
                        if len(out) >= 256:
                            yield _packed(out)
                            out = []
                    take = min(left, params.chunk - len(piece["symbols"]))
                    single = fresh and not blank and not again
                    piece["symbols"] += [symbol(initial, truncated) if single else MUST_GO] + [MUST_GO] * (take - 1)
                    piece["blank"] += take if blank else 0
                    piece["duplicate"] += 0 if blank else take - single
                    piece["truncated"] += single and truncated
                    piece["illegal"] += take - 1 + (piece["last"] is not None and piece["last"] + initial not in LEGAL)
                    piece["first"] = initial if piece["first"] is None else piece["first"]
                    piece["last"] = initial
                    if turn is not None and turn != piece["high"]:
                        piece["turns"] += 1
                        piece["low"] = turn if piece["low"] is None else piece["low"]
                        piece["high"] = turn
                    fresh, left = False, left - take
            if out:
                yield _packed(out)
                out = []
        if piece is not None:
            yield _packed([done()])

    dealt = rows.repartitionByRange("key", "turn", "digest").sortWithinPartitions("key", "turn", "digest")
    return written(dealt.select("key", "turn", "initial", "blank", "truncated", "again", "n").mapInArrow(run, PIECE), "pieces")


COUNTS = ("blank", "duplicate", "truncated", "illegal")
PIECE_SCHEMA = pa.schema([
    ("key", pa.string()), ("part", pa.int32()), ("k", pa.int32()), ("symbols", pa.binary()), ("rows", pa.int64()), *[(c, pa.int64()) for c in COUNTS],
    ("first_initial", pa.string()), ("last_initial", pa.string()), ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
])


def _piece() -> dict:
    return {"symbols": [], **dict.fromkeys(COUNTS, 0), "first": None, "last": None, "turns": 0, "low": None, "high": None}


def _packed(rows: list[tuple], schema: pa.Schema = PIECE_SCHEMA) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
RESULT_SCHEMA = pa.schema([("key", pa.string()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("cost", pa.int64()), ("audit", pa.string())])


class Conversation:
    """What the pieces of one conversation, taken in their order, add up to."""

    def __init__(self):
        self.counts, self.last, self.turns, self.low, self.high = dict.fromkeys(COUNTS, 0), None, 0, None, None
        self.ways: list = [[(0, "") if s == START else None for s in range(STATES)]]

    def add(self, piece: dict, own: list) -> None:
        """own: the piece's matrix, of one row if nothing came before."""
        for c in COUNTS:
            self.counts[c] += piece[c]
        if self.last is not None:
            self.counts["illegal"] += self.last + piece["first_initial"] not in LEGAL
        self.last = piece["last_initial"]
        if piece["turns"]:
            self.turns += piece["turns"] - (piece["first_turn"] == self.high)
            self.low = piece["first_turn"] if self.low is None else self.low
            self.high = piece["last_turn"]
        self.ways = product(self.ways, own)

    def result(self) -> tuple:
        ends = product(self.ways, INSERTS)[0]
        best = better(ends[LAST[0]], ends[LAST[1]])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *(self.counts[c] for c in COUNTS), best[0], text_of(best[1])


def solved(dealt: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation, from its pieces.

    A conversation's pieces come one after another and are forgotten; of the conversation its counts and the cheapest
    audit into each state are kept, about a byte a row.
    """

    def run(batches):
        known = matrices(rules)
        memo: dict[bytes, list] = {}
        now, conv, out = None, None, []
        for b in batches:
            rows = b.to_pylist()
            short = shortened([r["symbols"] for r in rows], rules)
            for r, s in zip(rows, short, strict=True):
                if r["key"] != now or conv is None:
                    if conv is not None:
                        out.append((now, *conv.result()))
                    now, conv = r["key"], Conversation()
                alone = s.tobytes()
                if (own := memo.get(alone)) is None:
                    own = INSERTS_NONE
                    for k in s.tolist():
                        own = product(own, known[k])
                    if len(alone) <= 64:
                        if len(memo) >= 20_000:
                            memo.clear()
                        memo[alone] = own
                conv.add(r, own)
            if out:
                yield _packed(out, RESULT_SCHEMA)
                out = []
        if conv is not None:
            yield _packed([(now, *conv.result())], RESULT_SCHEMA)

    return dealt.repartition("key").sortWithinPartitions("key", "part", "k").mapInArrow(run, RESULT)


#: The matrix of no row: every state stays.
INSERTS_NONE = [[(0, "") if s == t else None for t in range(STATES)] for s in range(STATES)]


class Repaired:
    """SHA-256 of a repaired conversation whose rows come one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.first = audit, 0, START, hashlib.sha256(), True

    def _line(self, line: str) -> None:
        self.hash.update((line if self.first else "\n" + line).encode("utf-8", "surrogatepass"))
        self.first = False

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == INSERT:
            role = NEXT[self.state]
            self._line(f"{ROLE[role]}:")
            self.state, self.at = MOVES[self.state, role], self.at + 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        e = self.audit[self.at]
        self.at += 1
        if e != DELETE:
            to = role[0] if e == KEEP else NEXT[self.state]
            self._line(f"{role if e == KEEP else ROLE[to]}:{text}")
            self.state = MOVES[self.state, to]

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """key, repaired_sha256 of each conversation of damaged rows, from its audit.

    The audit comes first, then the rows in their order; one hash runs through them, as SHA-256 must, so a conversation
    is read by one task, a batch of rows at a time.
    """
    texts = rows.select("key", F.lit(1).alias("kind"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), "role", "text", "n")
    none = F.lit(None)
    first = audits.select("key", F.lit(0).alias("kind"), none.cast("bigint").alias("turn"), none.cast("binary").alias("digest"), none.cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("n"))

    def run(batches):
        now, repaired, out = None, None, []
        schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
        for b in batches:
            for key, kind, role, text, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    if repaired is not None:
                        out.append((now, repaired.digest()))
                    now, repaired = key, Repaired(text)
                for _ in range(n):
                    repaired.row(role, text)
            if out:
                yield _packed(out, schema)
                out = []
        if repaired is not None:
            yield _packed([(now, repaired.digest())], schema)

    dealt = texts.unionByName(first).repartition("key").sortWithinPartitions("key", "kind", "turn", "digest")
    return dealt.select("key", "kind", "role", "text", "n").mapInArrow(run, "key string, repaired_sha256 string")


def repair(rows: DataFrame, original: DataFrame, params: Params = Params()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conv_id of original.

    rows: key, turn, role, text, n (damaged()); original: conv_id. Rows are ordered by turn, nulls first, rows of one turn
    by the digest of role and text, so repeated rows stand together. Rows without conv_id are one conversation. A role's
    initial is its first character; other initials than s, u, a can't be kept. Texts of any length are only hashed and
    looked at from their ends. A conversation without rows has zeros, no audit and the hash of nothing; no rows give none.
    """
    marked = written(faults(rows), "faults")
    dealt = pieces(marked, params)
    distinct = written(dealt.groupBy("symbols").agg(F.count("*").alias("n")), "strings")
    found = written(solved(dealt, grammar(distinct, params)), "solved")
    out = found.join(repaired_digests(rows, found.select("key", "audit")), "key")
    ids = original.select("conv_id").distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    counts = ["gaps", *COUNTS, "cost"]
    return ids.join(out, "key", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
