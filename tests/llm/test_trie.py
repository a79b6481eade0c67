import hashlib
import random
import re
from zlib import crc32

import pytest

from opsignal.llm import trie


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    """Nodes by their definition, from (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, t in own.items():
        t.sort(key=lambda r: (r[:2], hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
        own[c] = [r[2:] for r in t]
    members = {}
    for c in own:
        h = crc32(str(c).encode()) % 4
        root = c - (c % 20 if c >= 0 else -(-c % 20))
        built = tuple(own.get(root, [])[:h]) + tuple(own[c][h:])
        for d in range(len(built) + 1):
            members.setdefault(built[:d], []).append((c, len(built) == d))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids.get(p, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        out[p] = {
            "conv_id": min(c for c, _ in members[p]), "depth": len(p), "parent_conv_id": min(c for c, _ in members[p[:-1]]) if p else None,
            "n_convs": len(members[p]), "n_children": len(below), "n_leaves": sum(b["n_leaves"] for b in below) or 1,
            "saved_tokens": (len(members[p]) - 1) * words + sum(b["saved_tokens"] for b in below),
            "ends_sha256": sha(",".join(str(c) for c in sorted(c for c, ends in members[p] if ends))),
        }
    return sorted(tuple(sorted(r.items())) for r in out.values())


def run(spark, rows, params=trie.Params()):
    df = spark.createDataFrame([(*r, "x", None, 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, id string, at int")
    return sorted(tuple(sorted(r.asDict().items())) for r in trie.nodes(trie.rebuilt(trie.turns(df)), params).collect())


def key(r):
    return str(r)


def check(spark, rows, params=trie.Params()):
    assert sorted(run(spark, rows, params), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("shard", [400_000, 15])
def test_equals_brute_force(spark, shard):
    rng = random.Random(7)
    rows = []
    for c in [*range(60), -3, -20, -21, 1000, 10**12]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi there", "a b  c", "", None, f"own {c}", "é x"])))
    rng.shuffle(rows)
    check(spark, rows, trie.Params(shard_turns=shard))


@pytest.mark.parametrize("shard", [400_000, 30])
def test_copies_and_a_long_conversation_span_shards(spark, shard):
    """A conversation with most of all rows, copies in many shards, some of which go on in other ways."""
    rows = [(c, t, "user", f"same {t}") for c in range(0, 1600, 20) for t in range(3)]
    rows += [(c, 3, "assistant", "more" if c % 40 else f"only {c}") for c in range(0, 1600, 60)]
    rows += [(5, t, "user", "ok" if t % 2 else f"step {t}") for t in range(700)] + [(25, t, "user", "ok") for t in range(300)]
    check(spark, rows, trie.Params(shard_turns=shard))


def test_edges(spark):
    assert run(spark, []) == []
    check(spark, [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 5, "user", "word " * 20_000)])
    assert run(spark, [(None, 0, "user", "a")]) == []
