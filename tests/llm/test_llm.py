"""Each operator against a brute-force version, and on nulls, empty and very long texts, ties, repeats and empty tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opsignal.llm import chat, components, decontam, exact, langid, lm, pieces, queries, simhash, suffix, toxicity, urls
from opsignal.llm.common import named, with_ids

EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (6, "one two"), (7, "é ß 漢字 😀 \x00 ▁ </s>"),
    (8, "word " * 3000), (9, "x" * 20_000), (-3, "the same text stands here, long enough to be a passage of fifty bytes"),
    (10, "the same text stands here, long enough to be a passage of fifty bytes"), (11, "..."),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- exact dedup ---------------------------------------------------------------------------------
def test_exact_edges(edges):
    want = []
    for i, t in EDGES:
        same = [j for j, u in EDGES if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(exact.dedup(edges)) == sorted(want, key=str)


def test_exact_with_history_groups_new_texts_apart(documents):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.dedup(documents([(10, "a"), (11, "b"), (12, "b")]), documents([(3, "a"), (4, "a")])).collect()}
    assert got == {10: (4, 2), 11: (12, 2), 12: (12, 2)}


def test_exact_empty(documents):
    assert exact.dedup(documents([])).count() == 0


def test_perfect_hash_is_minimal_and_checks_bytes():
    rng = np.random.RandomState(1)
    raw = rng.randint(0, 256, (5000, 32)).astype(np.uint8)
    widths, bits, slot = exact.build_hash(raw)
    assert sorted(slot) == list(range(5000))
    table = raw[np.argsort(slot)]
    assert (exact.find(raw, widths, bits, table) == slot).all()
    other = raw.copy()
    other[:, 31] ^= 1  # same hash input, other bytes
    assert (exact.find(other, widths, bits, table) == -1).all()


def test_exact_cuts_a_hot_shard(documents):
    docs = documents([(i, "same") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(50)])
    d = exact.digests(docs)
    index, shards = exact.build_index(d, keys_per_shard=10)
    found = exact.look_up(d, index, shards, rows_per_task=20)
    assert found.filter("member and winner = 299 and size = 300").count() == 300 and found.count() == 350


# --- SimHash -------------------------------------------------------------------------------------
def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_edges(edges):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.groups(edges).collect()}
    fps = [(i, fingerprint(t)) for i, t in EDGES]
    parent = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if bin(fps[a][1] ^ fps[b][1]).count("1") <= 2:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(fps):
        if i is not None:
            ids[parent[k]].append(i)
    assert got == {(i, f"{f:016x}", min(ids[parent[k]], default=None)) for k, (i, f) in enumerate(fps)}


def test_links_are_all_pairs_within_the_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for x in base for _ in range(8)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(min(a, b), max(a, b)) for k, a in enumerate(signed) for b in signed[:k] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == want and want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_empty(documents):
    assert simhash.groups(documents([])).count() == 0


# --- pieces --------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_file=queries.piece_model())


def test_pieces_equal_the_library(library):
    own, rng = pieces.load(queries.piece_model()), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "the", "ing", "é", "ß", "字", "😀", "<s>", "<0x0A>", "▁", "a", "aaaa", "123", "....", "\x00", "²", "m²", "́", "\r\n", " 字", "_", "A"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)] + [" " * n + "x" for n in range(40)] + [t or "" for _, t in EDGES]
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids)


def test_decode_of_any_ids(library):
    own, rng = pieces.load(queries.piece_model()), random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(3, 400) for _ in range(rng.randint(0, 10))]
        assert own.decode(ids) == library.decode(ids)


def test_pieces_edges(edges, library):
    got = rows(queries.piece_digests(edges))
    want = []
    for i, t in EDGES:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


# --- language model ------------------------------------------------------------------------------
def test_lm_base_and_probabilities(documents):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["a", "b", "c", "D", "e e"], k=rng.randint(0, 30)))) for i in range(80)] + [(500, None), (501, "")]
    got = {r["doc_id"]: r for r in lm.score(documents(texts), lm.Params(block_tokens=100, part_keys=20)).collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0


def test_lm_blocks_don_t_matter(documents):
    docs = documents([(i, f"w{i % 5} x w{i % 3} y") for i in range(60)])
    a = rows(lm.score(docs).select("doc_id", F.round("score", 6)))
    b = rows(lm.score(docs, lm.Params(block_tokens=7, part_keys=3)).select("doc_id", F.round("score", 6)))
    assert a == b


def test_lm_edges(edges, documents):
    assert lm.score(edges).count() == len(EDGES)
    assert lm.score(documents([])).count() == 0
    only_held = [(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert all(math.isfinite(r["score"]) for r in lm.score(documents(only_held)).collect())


# --- suffixes ------------------------------------------------------------------------------------
def repeated(texts, least=50):
    first, out = {}, {}
    raw = [(i, (t or "").encode()) for i, t in texts]
    for i, b in sorted((x for x in raw if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(b) - least + 1):
            first.setdefault(b[k : k + least], i)
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - least + 1):
            if i is not None and first[b[k : k + least]] < i:
                gone[k : k + least] = [True] * least
        out.setdefault(i, []).append((len(b), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), bytes(c for c, g in zip(b, gone) if not g)))
    return out


def checked(docs, texts, p):
    want = repeated(texts)
    got = collections.defaultdict(list)
    for r in suffix.dedup(docs, p).collect():
        got[r["doc_id"]].append((r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])))
    assert got == want


def test_suffix_edges(edges):
    checked(edges, EDGES, suffix.Params())


@pytest.mark.parametrize("hot", [2, 5000])
def test_suffix_passages(documents, hot):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(rng.randint(8, 40))) for _ in range(12)]
    texts = []
    for i in rng.sample(range(-50, 400), 120):
        body = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(passages)
            body.insert(rng.randint(0, len(body)), s[rng.randint(0, 8) : len(s) - rng.randint(0, 8)])
        texts.append((i, "".join(body)))
    checked(documents(texts), texts, suffix.Params(hot=hot, block_bytes=3000, part_keys=500, part_strings=50, chunk=400))


@pytest.mark.parametrize("cut", [-1, 1000])
def test_suffix_hot_anchor_takes_one_way(documents, cut):
    rng = random.Random(15)
    text = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = text(75)
    around = text(60) + passage + text(60)
    texts = [(i, around) for i in range(30)] + [(cut, text(60) + passage + text(60))] + [(2000 + i, text(200)) for i in range(3)]
    checked(documents(texts), texts, suffix.Params(hot=2, block_bytes=600, part_keys=50, part_strings=2))
    texts = [(i, around) for i in range(30)] + [(cut, text(60) + passage), (cut + 1000, passage[10:] + text(70))]
    checked(documents(texts), texts, suffix.Params(hot=30, block_bytes=600, part_keys=50, part_strings=2))


def test_collection_sorts_suffixes():
    rng = random.Random(7)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(40)]
    width = max(map(len, strings))
    matrix = np.array([list(s.rjust(width, b"\0")) for s in strings], dtype=np.uint8)
    c = suffix.Collection(matrix, np.array([len(s) for s in strings]), 8, 16)
    order = np.concatenate(list(c.owners.chunks(1000)))
    prefixes = np.concatenate(list(c.prefixes.chunks(1000)))
    found = [strings[x >> 7][len(strings[x >> 7]) - (x & 127) :] for x in order.tolist()]
    assert found == sorted(s[k:] for s in strings for k in range(len(s) + 1))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert prefixes[1:].tolist() == [min(8, common(a, b)) for a, b in zip(found, found[1:])]


def test_suffix_empty(documents):
    assert suffix.dedup(documents([])).count() == 0


# --- decontamination -----------------------------------------------------------------------------
def test_decontamination(spark, documents):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    items = [(i, text(rng.randint(20, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "one two"), (93, "...")]
    docs, want = [(100, None), (101, ""), (102, "one two"), (103, "one two three")], {(102, 92)}
    for k in range(60):
        body = text(rng.randint(0, 300)).split()
        if k % 3 == 0:
            i, t = items[k % 30]
            w = t.upper().split()
            if k % 2:
                w = w[1:]  # still four fifths of the shingles
            at = rng.randint(0, len(body))
            body[at:at] = w
            want.add((k, i))
        docs.append((k, " , ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for p in (decontam.Params(), decontam.Params(item_bytes=500, text_bytes=700)):
        found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(documents(docs), bench, p).collect()}
        assert found == want
    assert decontam.contaminated(documents([]), bench).count() == 0
    assert decontam.contaminated(documents(docs), bench.limit(0)).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.RandomState(9)
    stored = rng.randint(0, 1 << 62, 50).astype(np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(62, rng.randint(0, 30), replace=False)) for _ in range(400)]
    queries_ = stored[rng.randint(0, 50, 400)] ^ np.array(flips, dtype=np.uint64)
    q, s, d = decontam.HammingIndex(stored, 19, 4).search(queries_)
    distance = np.bitwise_count(queries_[:, None] ^ stored[None, :])
    assert set(zip(q.tolist(), s.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= 19))))


# --- language, toxicity, urls, chat --------------------------------------------------------------
def test_language(spark):
    rng = random.Random(10)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["foxes", "jumping", "lazily"], "cc": ["ñandú", "çedilha", "über"]}
    data = [(i, " ".join(rng.choices(words[k], k=30)), k) for i, k in enumerate(rng.choices(list(words), k=90))]
    model = langid.fit(spark.createDataFrame(data[:60], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(data, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 and not got[i]["rejected"] for i, _, k in data)
    assert langid.Judge(model)(None) == langid.Judge(model)("12 !") == ("und", 0.0, True)
    judged = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert langid.clear(judged, model).count() == len(data)


def test_language_edges(edges, documents):
    model = langid.fit(documents([(1, "some text here")]))
    assert langid.predict(edges, model).count() == len(EDGES)
    assert langid.fit(documents([])).dictionaries == {}
    assert {r["lang_pred"] for r in langid.predict(edges, langid.fit(documents([]))).collect()} == {"und"}
    assert langid.predict(documents([]), model).count() == 0


def test_long_texts_of_one_language_are_clear(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text is not null and lang is not null")
    judge = langid.Judge(langid.fit(docs.filter(~langid.is_held_out(F.col("doc_id")))))
    texts = collections.defaultdict(str)
    for r in docs.orderBy("doc_id").select("lang", "text").toLocalIterator():
        if len(texts[r["lang"]]) < 10 << 20:
            texts[r["lang"]] += " " + r["text"]
    assert len(texts) > 1
    for lang, whole in texts.items():
        for text in (whole[: 1 << 20], whole, whole * -(-(10 << 20) // len(whole))):
            got, _, rejected = judge(text)
            assert (got, rejected) == (lang, False)


def test_toxicity(spark, documents):
    rng = random.Random(11)
    calm, bad = [f"word{i}" for i in range(60)], ["idiotic", "awfulness", "scummy"]
    texts = [(i, " ".join(rng.choices(calm, k=25) + (rng.choices(bad, k=1 + i % 3) if i % 5 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in texts[:300]] + [(999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(texts), toxicity.severity_grades(labels), toxicity.Params(split=True))
    got = {r["doc_id"]: r for r in toxicity.score(documents(texts), model).collect()}
    assert [got[i]["toxic"] for i, _ in texts] == [i % 5 == 0 for i, _ in texts]
    assert list(model.thresholds) == sorted(model.thresholds)
    assert all(0 <= r["expected_severity"] <= 2 for r in got.values())
    most = [r["expected_severity"] for i, r in got.items() if i % 15 == 10]
    least = [r["expected_severity"] for i, r in got.items() if i % 15 == 0]
    assert sum(most) / len(most) > sum(least) / len(least)


def test_toxicity_learns_the_grades_of_its_labels(spark, documents):
    rng = random.Random(21)
    calm, marks = [f"word{i}" for i in range(60)], {1: ["rude", "silly"], 2: ["awful", "vile"], 4: ["hateful", "cruel"]}
    grade = {i: [0, 0, 0, 1, 2, 4][i % 6] for i in range(600)}
    texts = [(i, " ".join(rng.choices(calm, k=20) + rng.choices(marks.get(g, ["fine"]), k=2))) for i, g in grade.items()]
    texts += [(3, "short")] * 5 + [(9, "y" * 200_000 + " vile")]  # rows that repeat an id, and one very long word
    labels = spark.createDataFrame([(i, g) for i, g in grade.items() if i < 500], "doc_id long, grade int")
    model = toxicity.fit(documents(texts), labels, toxicity.Params(features=50))
    assert model.grades == (0, 1, 2, 4) and len(model.thresholds) == 3 and list(model.thresholds) == sorted(model.thresholds)
    assert len(model.weights) <= 50 and max(map(len, model.weights)) <= 64
    got = {r["doc_id"]: r for r in toxicity.score(documents(texts[:600]), model).collect()}
    assert sum(got[i]["severity"] == grade[i] for i in range(500, 600)) >= 95
    toxic = [i for i in range(500, 600) if grade[i]]
    assert all(got[i]["toxic"] for i in toxic) and all(got[i]["expected_severity"] > 0.5 for i in toxic)


def test_descent_reaches_the_least_plain_loss():
    """No step in any one direction from the descent's end lowers the likelihood, written out grade by grade, by much."""
    rng = np.random.RandomState(5)
    rows = [np.flatnonzero(rng.rand(6) < 0.4) for _ in range(300)]
    truth = np.array([1.5, -1.0, 0.5, 0.0, 2.0, -0.5])
    level = np.array([int(np.searchsorted([-0.5, 1.5], truth[r].sum() + rng.logistic())) for r in rows])

    def loss(w, limits):
        total = 0.0
        for r, g in zip(rows, level, strict=True):
            up = [1.0, *(1 / (1 + math.exp(-(w[r].sum() - t))) for t in limits), 0.0]
            total -= math.log(max(up[g] - up[g + 1], 1e-12))
        return total / len(rows)

    w, limits = toxicity.descend(rows, level, 2, toxicity.Params(shrink=0.0, rounds=3000), 6)
    best = loss(w, limits)
    for k in range(6):
        for d in (-0.05, 0.05):
            other = w.copy()
            other[k] += d
            assert loss(other, limits) > best - 1e-4
    for k in range(2):
        for d in (-0.05, 0.05):
            other = limits.copy()
            other[k] += d
            assert loss(w, other) > best - 1e-4


def test_toxicity_edges(spark, edges, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edges, toxicity.severity_grades(none))
    got = toxicity.score(edges, model).collect()
    assert len(got) == len(EDGES) and not any(r["toxic"] for r in got)
    assert toxicity.score(documents([]), model).count() == 0


PAGES = "page_id long, url string, host string, score double"


def test_urls(spark):
    data = [
        ("http://A.Example.NET/en/1?q", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"),
        ("https://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"), ("https://notexample.com/de/", "notexample.com", "/de/", None, None),
        ("https://example.com/de/#a/b", "example.com", "/de/", "example.com/de/", "block"), ("http://x.net", "x.net", "", None, None),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("a://" + "p" * 5000, "p" * 5000, "", None, None),
    ]
    df = spark.createDataFrame([(i, d[0], "h", 0.0) for i, d in enumerate(data)], PAGES)
    model = urls.fit(urls.labelled_by_rules(df, queries.RULES), urls.Params(rounds=3))
    got = {r["page_id"]: r for r in urls.judge(df, queries.RULES, model).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(data):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= 0.5 else "allow"))
    empty = df.limit(0)
    assert urls.judge(empty, queries.RULES, urls.fit(urls.labelled_by_rules(empty, queries.RULES))).count() == 0


def test_url_method_learns(spark):
    rng = random.Random(12)
    make = lambda bad: ("ads" if bad else "news") + "".join(rng.choices("xyz", k=3)) + ".com"
    data = [(make(i % 2), "/p", bool(i % 2)) for i in range(300)]
    model = urls.fit(spark.createDataFrame(data[:200], "host string, path string, blocked boolean"))
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(data)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] == "block" for r in urls.judge(pages, [], model).collect()}
    assert sum(got[i] == data[i][2] for i in range(200, 300)) >= 95


def test_chat_reads_back_any_text(spark):
    rng = random.Random(13)
    bits = [*chat.DEFAULT.control, "&", "&lt;", "&amp;", "&lbr;", "<", "[", "]", ">", " ", "\n", "é", "x", "s>", "INST]", " [/INST]", "</"]
    data = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            text = None if rng.random() < 0.05 else "".join(rng.choices(bits, k=rng.randint(0, 9)))
            data.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", "system", "tool", None, "<s>"]), text))
    out = chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    got = out.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("segments")).alias("l")).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in data:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    for r in got:
        turns = [(a, b) for *_, a, b in sorted(want[r["conv_id"]])]
        assert [tuple(x) for x in r["t"]] == turns
        assert r["l"] == "".join(b for a, b in turns if a == "assistant")


@pytest.mark.parametrize("roles, valid, bad", [
    (["user", "assistant"], True, None), (["system", "user", "assistant"], True, None), (["user"], False, None), (["assistant", "user"], False, 0),
    (["user", "user"], False, 1), (["user", "assistant", "system"], False, 2), (["tool"], False, 0),
])
def test_chat_turn_order(spark, roles, valid, bad):
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df).first()
    assert (r["valid"], r["bad_turn"]) == (valid, bad)


# --- pipeline ------------------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language", "exact_copies", "near_copies", "benchmark_leaks", "encode"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("fingerprint", F.lit(1))
    extra = [(100000, None, "en", "s", 0, 1), (100001, "", "en", "s", 0, 1), (None, "some words of a text that nobody else has written down", "en", "s", 0, 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for name, stage in cp.STAGES[:-1]:
        before = docs
        out = str(tmp_path / name)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == before.columns and docs.count() <= before.count()
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts) and None not in texts
    assert cp.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == len(texts)
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_rows_without_id_are_told_apart_by_their_texts(documents):
    docs = documents([(1, "a"), (None, "b"), (None, "c"), (2, "d"), (2, "e")])
    ids = {r["text"]: r["doc_id"] for r in named(docs).collect()}
    assert len(set(ids.values())) == 4 and (ids["a"], ids["d"], ids["e"]) == (1, 2, 2)
    some = named(docs).filter("text in ('b', 'd')")
    assert {r["text"] for r in with_ids(docs, some).collect()} == {"b", "d", "e"}
    assert {r["text"] for r in with_ids(docs, some, "left_anti").collect()} == {"a", "c"}


def test_pipeline_decides_row_by_row(spark, documents, tmp_path):
    """Copies, near copies and leaks go, one of each group stays; clean rows without an id stay beside one that leaks."""
    import corpus_pipeline as cp

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefg") + str(rng.randrange(900)) for _ in range(n))
    item, base, clean = text(40), text(400), [text(60) for _ in range(4)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents([(1, clean[0]), (9, clean[0]), (None, clean[1]), (None, clean[2] + " " + item), (4, base), (5, base + " end"), (6, text(20) + " " + item)])
    kept = cp.exact_copies(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 4, 5, 6, 9]
    far = {r["doc_id"]: r["fingerprint"] for r in simhash.groups(docs.filter("doc_id in (4, 5)")).collect()}
    near = bin(int(far[4], 16) ^ int(far[5], 16)).count("1") <= 2
    kept = cp.near_copies(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {1, None, 4, 6} | (set() if near else {5}) and near
    kept = cp.benchmark_leaks(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 9]


def test_language_fit_is_bounded_and_survives_odd_tables(spark):
    """Null and repeated ids, columns named like the operator's own."""
    rows = [(None if i % 2 else 7, f"wort satz {i} und noch ein wort", "de", 1, 2) for i in range(400)] + [(None, "x", "en", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, at int, of int")
    p = langid.Params(candidates=5, dictionary_bytes=200)
    model = langid.fit(docs, p)
    assert set(model.dictionaries) == {"de", "en"} and all(len(d) <= 200 for d in model.dictionaries.values())
    assert langid.predict(docs, model).count() == 401 and langid.clear(docs, model).columns == docs.columns
    with pytest.raises(ValueError):
        langid.fit(docs, langid.Params(languages=1))
