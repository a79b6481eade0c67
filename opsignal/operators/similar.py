"""Similarity: exact k nearest neighbours, known-incident matching, incident text and term vectors.

The neighbour search is exact and never forms all pairs.  Vectors are unit length, so cosine order is
Euclidean order and the triangle inequality holds:

1. a few pivot vectors (a fixed number) cut the corpus into Voronoi cells;
2. per cell, the radius, the count and the k smallest distances to the pivot are kept, which bounds
   the distance of any query to its k-th neighbour from above;
3. a query goes only to cells whose lower bound does not exceed that, and cells are cut into blocks
   of bounded size, so one crowded cell becomes many tasks;
4. a task multiplies one block of queries by one block of corpus vectors, a tile at a time, and emits k
   rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.vectors import clamp01, dot, norm

SLACK = 1e-6
#: What rounding may add to or take from a cosine distance.
NOISE = 1e-9
#: So many tasks of a search, if each has as many pairs.
TASKS, TASK_PAIRS = 128, 1 << 26


def _vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, v, len): vectors as given and their lengths in double precision; zero vectors are left out."""
    rows = df.select(F.col(key).alias("id"), F.col(vec).alias("v"))
    return rows.withColumn("len", norm("v")).filter(F.col("len") > 0)


def _unit(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Unit vectors in double precision."""
    v, n = rows.column("v"), rows.column("len")
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(v), -1).astype(np.float64) / np.asarray(n.to_numpy())[:, None]


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (unit @ pivots.T), 0.0))


def _id_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def _neighbour_schema(q: DataFrame, c: DataFrame) -> str:
    return f"query_id {_id_type(q)}, neighbour_id {_id_type(c)}, distance double"


def _coded(asked: pa.ChunkedArray, ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block of queries and one of the corpus as whole numbers in the order of the corpus; an id that it lacks is -1, a null -2."""
    known = ids.unique().drop_null()
    known = known.take(pc.array_sort_indices(known))
    code = lambda x, other: pc.fill_null(pc.index_in(x, value_set=known), other).to_numpy()
    return code(asked.cast(ids.type), -1), code(ids, -2)


def _grid(asked: int, n: int, pairs: int, rows: int) -> tuple[int, int]:
    """How many blocks the queries and the corpus vectors of a cell are cut into, of `rows` rows at most.

    A query is copied to each block of the corpus, a vector to each of the queries. Of the grids with this cell's share
    of the tasks it is the one with the fewest copies; the number of tasks doesn't follow the tables, so neither do the copies of a row.
    """
    least_q, least_c = max(1, math.ceil(asked / rows)), max(1, math.ceil(n / rows))
    tasks = min(math.ceil(TASKS * asked * n / max(pairs, 1)), math.ceil(asked * n / TASK_PAIRS))
    grids = [(max(least_q, math.ceil(tasks / c)), c) for c in range(least_c, max(least_c, tasks) + 1)]
    return min(grids, key=lambda g: asked * g[1] + n * g[0])


def _nearest(asked: np.ndarray, qs: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, ...]:
    """Query row, corpus row and distance of the k nearest of a block of corpus vectors for each of a block of queries.

    A tile of 256 by 4096 distances is in memory at a time. Products of matrices, in single precision, only say which pairs
    can be among the k; these are measured pair by pair, so that a distance doesn't depend on the block that a vector lies in.
    """
    found = []
    # double precision where vectors are too much alike for single precision
    kinds = ((np.float32, NOISE + (vectors.shape[1] + 8) * 2.0**-24), (np.float64, NOISE))
    many = max(64, 4 * k)
    for at in range(0, len(qs), 256):
        q, own = qs[at:at + 256], asked[at:at + 256]
        limit = np.full(len(q), np.inf)
        row, col, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for start in range(0, len(vectors), 4096):
            c = vectors[start:start + 4096]
            unknown = len(c) > k and not np.isfinite(limit).all()
            for kind, noise in kinds:
                dist = kind(1.0) - q.astype(kind, copy=False) @ c.astype(kind, copy=False).T
                if exclude_self:
                    dist[own[:, None] == ids[None, start:start + 4096]] = np.inf
                if unknown:
                    limit = np.minimum(limit, np.partition(dist, k - 1, axis=1)[:, k - 1] + noise)
                near = np.flatnonzero((dist <= (limit + noise).astype(kind)[:, None]) & (dist < np.inf))
                if len(near) <= many * len(q):
                    break
            if not len(near):
                continue
            r, j = np.divmod(near, len(c))
            exact = np.concatenate([1.0 - np.einsum("ij,ij->i", q[r[i:i + 65536]], c[j[i:i + 65536]]) for i in range(0, len(r), 65536)])
            row, col, far = np.concatenate([row, r]), np.concatenate([col, j + start]), np.concatenate([far, exact])
            order = np.lexsort((ids[col], far, row))
            row, col, far = row[order], col[order], far[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            limit[row[nth == k - 1]] = far[nth == k - 1]
            row, col, far = row[nth < k], col[nth < k], far[nth < k]
        found.append((row + at, col, far))
    return tuple(np.concatenate(x) for x in zip(*found))


def knn(
    queries: DataFrame, corpus: DataFrame, k: int = fv.KNN_CANDIDATES, key: str = "id", vec: str = "embedding",
    exclude_self: bool = True, pivots: int = 16, block: int | None = None,
) -> DataFrame:
    """(query_id, neighbour_id, distance, rank): the k corpus rows nearest to each query by cosine distance.

    Ties go to the smaller id. With exclude_self a query never meets the corpus row of its own id. The
    queries are the new incidents, the corpus all earlier ones; both are cut into blocks, and a block of
    queries meets only the cells of the corpus that can hold a neighbour. A block has at most `block` rows, as
    many as have 8 million numbers if not given: a row is copied once for each block that it meets.
    """
    q, c = _vectors(queries, key, vec), _vectors(corpus, key, vec)
    # A fixed number of pivots; they only shape the cells, never the result.
    first = c.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    out_schema = _neighbour_schema(q, c)
    if not first:
        return queries.sparkSession.createDataFrame([], out_schema + ", rank int")
    p = np.array([r["v"] for r in first], dtype=np.float64) / np.array([[r["len"]] for r in first])
    n_cells = len(first)
    block = block or max(4096, (8 << 20) // p.shape[1])
    pivot_gap = np.sqrt(np.maximum(2.0 - 2.0 * (p @ p.T), 0.0))

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if b.num_rows:
                d = _distances(_unit(b), p)
                yield b.append_column("cell", pa.array(d.argmin(axis=1), pa.int32())).append_column("d", pa.array(d.min(axis=1)))

    fields = lambda df: f"id {_id_type(df)}, v {df.schema['v'].dataType.simpleString()}, len double"
    cells = c.mapInArrow(assign, f"{fields(c)}, cell int, d double")
    need = k + 1 if exclude_self else k
    extent = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()}
    nearest = Window.partitionBy("cell").orderBy("d", "id")
    slices = cells.select("cell", "d", "id", F.pmod(F.xxhash64("id"), F.lit(16)).alias("_s"))
    slices = slices.withColumn("_r", F.row_number().over(Window.partitionBy("cell", "_s").orderBy("d", "id"))).filter(F.col("_r") <= need)
    near = slices.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= need).select("cell", "d").collect()
    near_cell = np.array([r["cell"] for r in near], dtype=int)
    near_d = np.array([r["d"] for r in near])
    n = np.array([extent[i]["n"] if i in extent else 0 for i in range(n_cells)])
    lo = np.array([extent[i]["lo"] if i in extent else 0.0 for i in range(n_cells)])
    hi = np.array([extent[i]["hi"] if i in extent else 0.0 for i in range(n_cells)])

    def targets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            d = _distances(_unit(b), p)
            upper = d[:, near_cell] + near_d
            upper = np.partition(upper, need - 1, axis=1)[:, need - 1] if upper.shape[1] >= need else np.full(len(d), np.inf)
            gap = pivot_gap[d.argmin(axis=1)]
            bisector = np.where(gap > 0, (d**2 - d.min(axis=1, keepdims=True) ** 2) / np.where(gap > 0, 2 * gap, 1.0), 0.0)
            lower = np.maximum.reduce([bisector, d - hi, lo - d])
            hit = (lower <= upper[:, None] + SLACK) & (n > 0)
            ends = np.concatenate([[0], hit.sum(axis=1).cumsum()])
            met = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(hit)[1], pa.int32()))
            yield b.append_column("cells", met)

    routed = q.mapInArrow(targets, f"{fields(q)}, cells array<int>").select("id", "v", "len", F.explode("cells").alias("cell"))
    # Few numbers: how many blocks each cell needs.
    asked = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    load = [(asked.get(i, 0), int(n[i])) for i in range(n_cells)]
    query_blocks, corpus_blocks = zip(*[_grid(a, x, sum(b * y for b, y in load), block) for a, x in load])
    per_cell = lambda values: F.array(*[F.lit(int(v)) for v in values])[F.col("cell")]

    qb = routed.withColumn("qb", F.pmod(F.xxhash64("id"), per_cell(query_blocks)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), per_cell(corpus_blocks) - 1))
    )
    cb = cells.select("id", "v", "len", "cell", F.pmod(F.xxhash64("id"), per_cell(corpus_blocks)).cast("int").alias("cb")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), per_cell(query_blocks) - 1))
    )

    def nearest_in_block(qs: pa.Table, cs: pa.Table) -> pa.Table:
        row, col, far = [], [], []
        if qs.num_rows and cs.num_rows:
            asked_ids, ids = _coded(qs.column("id"), cs.column("id"))
            row, col, far = _nearest(asked_ids, _unit(qs), ids, _unit(cs), k, exclude_self)
        return pa.table({
            "query_id": qs.column("id").take(pa.array(row, pa.int64())), "neighbour_id": cs.column("id").take(pa.array(col, pa.int64())),
            "distance": pa.array(far, pa.float64()),
        })

    on = ["cell", "cb", "qb"]
    local = qb.groupBy(*on).cogroup(cb.groupBy(*on)).applyInArrow(nearest_in_block, out_schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k)


def known_match(neighbours: DataFrame, limit: float = fv.KNOWN_DISTANCE) -> DataFrame:
    """Similarity of the nearest neighbour; below the distance limit it is a known incident."""
    best = neighbours.filter(F.col("rank") == 1)
    known = F.col("distance") < limit
    return best.select(
        "query_id", F.bround(1 - F.col("distance"), 4).alias("similarity"),
        F.when(known, F.col("neighbour_id")).alias("matched_id"), F.when(known, F.lit("known")).alias("route"),
    )


def incident_text(
    df: DataFrame, domain: str, services: str, templates: str, anomalies: str, rules: str, match_ids: str, top: int = 5
) -> Column:
    """Text that describes an incident by its signal content. anomalies is an array of struct(metric, zscore)."""
    listed = lambda c, sep=", ": F.array_join(c, sep)
    metric = F.transform(
        F.slice(anomalies, 1, top),
        lambda a: F.when(a["zscore"].isNotNull(), F.concat(a["metric"], F.lit("(z="), a["zscore"].cast("string"), F.lit(")"))).otherwise(a["metric"]),
    )
    part = lambda name, c, sep=", ": F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), listed(c, sep), F.lit(".")))
    where = F.when(F.size(services) > 0, listed(F.col(services))).otherwise("unknown")
    return F.concat_ws(
        " ",
        F.concat(F.col(domain), F.lit(" incident in "), where, F.lit(".")),
        part("Log patterns", F.slice(templates, 1, top), " | "),
        part("Anomalous metrics", metric),
        part("Falco", F.col(rules)),
        part("Sigma", F.col(match_ids)),
    )


def tfidf(df: DataFrame, key: str, text: str, spread: int = 22) -> DataFrame:
    """L2-normalised tf-idf weights in long form (key, term, weight), exact terms, whole texts.

    idf = ln((N + 1) / (df + 1)). Texts are dealt by key once, in parts of 8 million characters; their terms are counted, weighted and
    normalised where they lie. A term is common if it comes up for more than 1 / 2^spread as many keys as
    all texts have characters, so common terms have at most 2^spread characters in all, however large
    the vocabulary; their idf goes to all tasks. Only rows of rare terms travel: to their term, where
    they are counted, and back to their key.
    """
    size = df.agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).first()
    n_docs, chars = size["n"], size["chars"] or 0
    few, parts = chars >> spread, (chars >> 23) + 1
    texts = df.select(key, F.lower(F.col(text)).alias("_text")).repartition(parts, key)
    words = texts.select(key, F.explode(F.split("_text", r"[^\p{L}\p{N}]+")).alias("term")).filter(F.col("term") != "")
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    idf = F.log((n_docs + 1) / (F.col("df") + 1)).alias("idf")
    common = F.broadcast(tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") > few).select("term", idf))
    rare = tf.join(common, "term", "left_anti").withColumn("df", F.count("*").over(Window.partitionBy("term")))
    both = tf.join(common, "term").select(key, "term", "tf", "idf").unionByName(rare.select(key, "term", "tf", idf).repartition(parts, key))
    weighted = both.select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    # one document's distinct terms at a time
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    rows = weighted.withColumn("_len", length).filter(F.col("_len") > 0)
    return rows.select(key, "term", (F.col("w") / F.col("_len")).alias("weight"))


def stale_vectors(df: DataFrame, vec: str, text: str, marker: str = fv.STALE_TEXT_MARKER) -> DataFrame:
    """Rows to embed again: no vector, or a description in the old format (case-insensitive)."""
    missing = F.col(vec).isNull() | (F.size(vec) == 0)
    old = F.col(text).ilike(f"%{marker}%")
    return df.filter(missing | old).withColumn("reason", F.when(missing, "missing").otherwise("stale"))


def alignment_score(a: Column | str, b: Column | str) -> Column:
    """Dot product of unit vectors, clamped to 0..1."""
    return clamp01(dot(a, b))
