import hashlib
import random
import re
from functools import lru_cache
from itertools import product
from zlib import crc32

import pytest

from opsignal.llm import repair

SPACES = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string, digest string, key string, n int"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


@lru_cache(maxsize=None)
def cheapest(rows):
    """(cost, audit, roles) of all edit sequences of (initial, fault) rows, tried one by one."""
    best = None
    more = ["", "u", "a", "ua", "au"]
    for gaps in product(more, repeat=len(rows) + 1):
        for picks in product("KDua", repeat=len(rows)):
            cost, audit, roles, out = 3 * len("".join(gaps)), "", "", []
            for k, (initial, fault) in enumerate(rows):
                audit += "I" * len(gaps[k])
                roles += gaps[k]
                out += [(None, r) for r in gaps[k]]
                e = picks[k]
                if e != "D" and fault in ("blank", "duplicate"):
                    break
                audit += e if e in "KD" else "R"
                cost += {"K": 0, "D": 4}.get(e, 3) + (3 if e != "D" and fault == "truncated" else 0)
                if e != "D":
                    roles += (initial or "-") if e == "K" else e
                    out.append((k, None if e == "K" else e))
            else:
                audit += "I" * len(gaps[-1])
                roles += gaps[-1]
                out += [(None, r) for r in gaps[-1]]
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, tuple(out)
    return best


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        conv = convs.setdefault(c, [])
        kind = crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        conv += [(turn is not None, turn or 0, digest(role, text), turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for c, conv in convs.items():
        conv.sort(key=lambda r: r[:3])
        seen, coded = set(), []
        for *_, role, text in conv:
            bare = text.strip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            coded.append((role[:1], fault))
        cost, audit, kept = cheapest(tuple(coded)) if conv else (0, "", ())
        roles = {"u": "user", "a": "assistant"}
        lines = [f"{roles[r]}:" if k is None else f"{roles[r] if r else conv[k][4]}:{conv[k][5]}" for k, r in kept]
        turns = {r[3] for r in conv} - {None}
        faults = [f for _, f in coded]
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def run(spark, rows, params=repair.Params()):
    df = spark.createDataFrame([(*r, "d", "k", 3) for r in rows], ROWS)
    got = repair.repair(repair.damaged(df), df, params).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("params", [repair.Params(), repair.Params(rules=6, rounds=6, rules_a_round=1, chunk=2)])
def test_equals_trying_all_edits(spark, params):
    rng, rows = random.Random(3), []
    for c in [*range(60), -4, 10**11, None]:
        for t in range(rng.choice([1, 2, 2, 3])):
            rows.append((c, rng.choice([t, t, 2 * t, None]), rng.choice(["user", "assistant", "system", "tool", "u", "", None]),
                         rng.choice(["Yes.", "no", " \n", None, "", "Done! \t", "what? ", "ok."])))
    rng.shuffle(rows)
    assert run(spark, rows, params) == brute(rows)


def slow(coded):
    """(cost, audit) by whole strings over the machine's states."""
    moves, nxt = repair.MOVES, repair.NEXT
    ways = {0: (0, "")}

    def with_inserts(ways):
        for _ in range(3):
            for s, (c, a) in list(ways.items()):
                to = moves[s, nxt[s]]
                ways[to] = min(ways.get(to, (10**9, "")), (c + 3, a + "I"))
        return ways

    for initial, fault in coded:
        new = {}
        for s, (c, a) in with_inserts(ways).items():
            ends = [(s, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ends.append((moves[s, nxt[s]], 3 + more, "R"))
                if (s, initial) in moves:
                    ends.append((moves[s, initial], more, "K"))
            for to, d, e in ends:
                new[to] = min(new.get(to, (10**9, "")), (c + d, a + e))
        ways = new
    return min(with_inserts(ways)[s] for s in (0, 3) if s in ways)


def test_long_conversations_and_many_copies(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice([f"text {t}.", f"cut {t}", "again."])) for t in range(3000)]
    rows += [(c, t, ["user", "user", "system", "assistant"][t], "Same.") for c in range(100, 400) for t in range(4)]
    got = run(spark, rows, repair.Params(chunk=256))
    assert got == run(spark, rows, repair.Params(rules=0, chunk=5000))
    first = sorted((r for r in rows if r[0] == 1), key=lambda r: r[1])
    seen, coded = set(), []
    for c, t, role, text in first:
        kind = crc32(f"{c}:{t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            fault = "blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text[-1] not in ".!?" else ""
            seen.add((role, text))
            coded.append((role[0], fault))
    assert got[1][5:7] == slow(coded)


def test_edges(spark):
    assert run(spark, []) == {}
    dropped = next((c, t) for c in range(100) for t in range(9) if crc32(f"{c}:{t}".encode()) % 20 == 0)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, [(*dropped, "user", "a")]) == {dropped[0]: empty}
    rows = [(5, 0, "user", "x" * 2_000_000 + "."), (5, 0, "user", "x" * 2_000_000 + "."), (6, 1, "user", " " * 300_000)]
    assert run(spark, rows) == brute(rows)


def test_ropes_compare_as_their_text():
    rng = random.Random(1)
    ropes = ["", "K"]
    for _ in range(400):
        ropes.append(repair.join(rng.choice(ropes[-40:]), rng.choice([*ropes[-40:], "D", "R"])))
    ropes = [r for r in ropes if repair.size_of(r) < 5000]
    for _ in range(3000):
        a, b = rng.choice(ropes), rng.choice(ropes)
        x, y = repair.text_of(a), repair.text_of(b)
        assert repair.compare(a, b) == (x > y) - (x < y)
