import math
import random
import re
from collections import Counter

import pytest

from opsignal.llm import fertility, queries
from opsignal.llm.fertility import FIGURES

EDGES = ["a\x1fb c", "one two three", "é ß 漢字 😀 \x00 ▁ </s>", "word " * 3000, "x" * 20_000, " \n\t ", ""]


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def plain_figures(text, pieces, other, window=128):
    """From whole-text encodings and counts, window by window."""
    ids, n_other = pieces.encode(text), len(other.encode_ordinary(text))
    parts = max(1, len(ids) // window)
    shares = []
    for k in range(parts):
        part = [t for i, t in enumerate(ids) if i * parts // len(ids) == k]
        bits = -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())
        shares.append(bits / math.log2(max(2, len(part))))
    return len(ids), len(text) / len(ids), len(text) / n_other, sum(map(pieces.is_byte, ids)) / len(ids), sum(shares) / parts


def test_base_counts():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(25_000)), *(" ".join(rng.choice("ab") for _ in range(n)) for n in range(12)), "a b c\na b c\n\na b c\n x", "x " * 300, "# $%|<>*&", "a\x0bb\x1fc"]
    for text in texts + EDGES:
        assert fertility.base_figures(text or "") == plain_base(text)


def test_figures_equal_whole_encodings():
    p = queries.vocabularies()
    v = fertility.Vocabularies(p)
    rng = random.Random(4)
    words = ["the", "Straße", "naïve", "漢字", "☃", "running", "x" * 30, "\n", "12"]
    text = " ".join(rng.choice(words) for _ in range(6000))
    assert len(list(fertility.blocks(text, p))) > 1
    got, want = v.figures(text), plain_figures(text, v.pieces, v.bytes)
    assert got[0] == want[0] and got[3] == pytest.approx(want[3]) and got[1] == pytest.approx(want[1]) and got[4] == pytest.approx(want[4])
    assert got[2] == pytest.approx(want[2], rel=2e-3)  # the byte vocabulary has the space at a cut
    v.figures("x" * 3_000_000)  # a run without white space is cut


def test_verdicts_follow_the_bands(spark):
    rng = random.Random(1)
    letters = {"en": "abcdefghij", "ru": "абвгдежзик"}
    rows = []
    for k in range(400):
        lang = ["en", "ru"][k % 2]
        vocabulary = ["".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(60)]
        rows.append((k, " ".join(rng.choice(vocabulary) for _ in range(90)), lang if k % 5 else None, "x"))
    rows += [(1000, " ".join("☃𝄞𓀀"[rng.randrange(3)] * 3 + str(i) for i in range(80)), "en", "x"), (1001, None, "en", "x"), (1002, "", None, "x")]
    got = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, script string"), queries.vocabularies()).collect()}
    assert all(got[k]["kept"] for k in range(400))
    assert got[0]["band"] == "LATIN" and got[1]["band"] == "ru" and got[5]["band"] == "CYRILLIC"
    assert not got[1000]["kept"] and not got[1000]["base_failed"] and "fallback" in got[1000]["outside"]
    assert got[1001]["base_failed"] and not got[1002]["kept"] and got[1001]["n_tokens"] == 0
    low = {c: sorted(got[k][c] for k in range(400) if rows[k][2] == "ru") for c in FIGURES}
    for c, slack in zip(FIGURES, queries.vocabularies().slack, strict=True):  # the bands, from sorted values
        a, b = low[c][math.ceil(len(low[c]) * 0.25) - 1], low[c][math.ceil(len(low[c]) * 0.75) - 1]
        reach = max((b - a) * 4, slack)
        for r in got.values():
            if r["band"] == "ru":
                assert (c in r["outside"]) == (not a - reach <= r[c] <= b + reach)


def test_edges(spark, edges, documents):
    got = fertility.judge(edges, queries.vocabularies()).collect()
    assert len(got) == edges.count()
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not r["kept"] or not r["base_failed"]
    assert fertility.judge(documents([]), queries.vocabularies()).count() == 0
