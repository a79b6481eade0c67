import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from opsignal.operators import similar


def shuffled(node):
    """Records written to exchanges by a query that has run."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(node.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled(node.plan())
    metrics, children = node.metrics(), node.children()
    own = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") else 0
    return own + sum(shuffled(children.apply(i)) for i in range(children.size()))


# --- term vectors
def documents(seed=8):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["the", "a", "Pod", "log", "é", "x9"]) + str(r.choice(["", "", r.randint(0, 400)])) for _ in range(60))) for i in range(80)]
    return rows + [(3, "the the again"), (None, "null the"), (None, "null key"), (90, None), (91, ""), (92, "...")]


def expected_weights(rows):
    counts = defaultdict(Counter)
    for key, text in rows:
        counts[key].update(x for x in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split())
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for key, c in counts.items():
        w = {t: n * math.log((len(rows) + 1) / (df[t] + 1)) for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        out |= {(key, t): x / size for t, x in w.items() if size > 0}
    return out


@pytest.mark.parametrize("spread", [22, 9, 1])
def test_weights_are_the_same_however_many_terms_are_common(spark, spread):
    rows = documents()
    got = similar.tfidf(spark.createDataFrame(rows, "k long, body string"), "k", "body", spread).collect()
    want = expected_weights(rows)
    assert len(got) == len(want)
    for r in got:
        assert r["weight"] == pytest.approx(want[r["k"], r["term"]], rel=1e-9)


def test_counts_of_common_terms_stay_with_their_texts(spark):
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.randint(0, 150)}" for _ in range(100))) for i in range(400)]
    df = similar.tfidf(spark.createDataFrame(rows, "k long, body string"), "k", "body")
    n = len(df.collect())
    assert n > 20000 and shuffled(df._jdf.queryExecution().executedPlan()) < n / 4


def test_no_texts_no_weights(spark):
    assert similar.tfidf(spark.createDataFrame([], "k long, body string"), "k", "body").collect() == []


# --- nearest neighbours
VECTOR = "id long, embedding array<float>"


def vectors(n, dims=8, seed=6):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)).astype(np.float32)
    v[n // 2:] = v[:n - n // 2] * rng.choice([1.0, 2.0], size=(n - n // 2, 1)).astype(np.float32)  # copies, some of other length
    return [(i * 7 % n, x.tolist()) for i, x in enumerate(v)]


def expected_neighbours(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    out = {}
    for i, v in zip(ids, x):
        d = np.where(ids == i, np.inf, np.round(1.0 - x @ v, 9))
        out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d))[:k]]
    return out


@pytest.mark.parametrize("block", [None, 40])
def test_neighbours_are_those_of_a_plain_search_in_any_blocks(spark, block):
    rows = vectors(300)
    df = spark.createDataFrame([*rows, (900, [0.0] * 8), (901, None)], VECTOR)
    got = defaultdict(list)
    for r in similar.knn(df, df, 4, block=block).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["neighbour_id"], r["distance"]))
    want = expected_neighbours(rows, 4)
    assert got.keys() == want.keys()
    for i, found in want.items():
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in found], abs=1e-8)
        # all but the last, which may tie with one that isn't listed
        assert sorted(a for a, d in got[i] if d < found[-1][1] - 1e-8) == sorted(a for a, d in found if d < found[-1][1] - 1e-8)


def test_repeated_ids_and_ids_of_null(spark):
    v = lambda a: [math.cos(a), math.sin(a)]
    q = spark.createDataFrame([(1, v(0.0)), (1, v(0.0)), (2, v(0.5)), (None, v(1.1))], VECTOR)
    c = spark.createDataFrame([(1, v(0.0)), (2, v(0.1)), (2, v(0.1)), (3, v(0.3)), (None, v(1.1))], VECTOR)
    got = defaultdict(list)
    for r in similar.knn(q, c, 3, pivots=1).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["neighbour_id"])
    assert got == {1: [2, 2, 2], 2: [3, 1, None], None: [None, 3, 2]}


def test_a_vector_is_copied_once_for_each_block_it_meets(spark):
    df = spark.createDataFrame(vectors(9000), VECTOR).repartition(4)
    found = similar.knn(df, df, 2, pivots=1)
    assert found.count() == 18000
    found.collect()
    assert shuffled(found._jdf.queryExecution().executedPlan()) < 60000


def test_queries_and_corpus_are_cut_into_as_few_blocks(spark):
    df = spark.createDataFrame(vectors(3000), VECTOR).repartition(4)
    found = similar.knn(df, df, 2, pivots=1, block=300)
    found.collect()
    # ten copies on either side, two neighbours from each block of the corpus, and what shapes the cells
    assert shuffled(found._jdf.queryExecution().executedPlan()) < 3000 * (10 + 10 + 2 * 10) + 10000


@pytest.mark.parametrize("n", [2000, 10256, 102564, 615384])
def test_copies_of_a_row_do_not_follow_the_size_of_the_tables(n):
    cells = [n // 32] * 8 + [3 * n // 32] * 8  # all queries meet all of them
    grids = [similar._grid(n, c, n * sum(cells), 131072) for c in cells]
    copies = sum(n * c + x * q for (q, c), x in zip(grids, cells)) / n
    assert copies <= 16 + 13 and all(n / q <= 131072 and x / c <= 131072 for (q, c), x in zip(grids, cells))
    assert n < 102564 or sum(q * c for q, c in grids) >= similar.TASKS


def test_blocks_of_a_cell_that_nobody_asks_or_that_holds_all():
    assert similar._grid(0, 500, 0, 100) == (1, 5) and similar._grid(500, 0, 0, 100) == (5, 1)
    q, c = similar._grid(100000, 100000, 100000**2, 131072)
    assert q * c >= similar.TASKS and q + c < 24


def test_distances_that_single_precision_cannot_tell_apart():
    rng = np.random.default_rng(3)
    n, dims = 6000, 16
    a = rng.permutation(n) * 1e-8 + 0.3
    x = np.zeros((n, dims))
    x[:, 0] = np.cos(a)
    x[np.arange(n), 1 + np.arange(n) % 15] = np.sin(a)
    q = np.eye(dims)[:1]
    row, col, far = similar._nearest(np.array([-1]), q, np.arange(n), x, 50, True)
    want = np.lexsort((np.arange(n), 1.0 - x[:, 0]))[:50]
    assert (row == 0).all() and col.tolist() == want.tolist() and far == pytest.approx(1.0 - x[want, 0], abs=1e-15)


def test_a_task_holds_a_tile_of_distances(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(16384, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    ids = np.arange(16384)
    tracemalloc.start()
    row, col, far = similar._nearest(ids[:4096], x[:4096], ids, x, 5, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row) == 5 * 4096 and (row != col).all() and peak < 64 << 20
