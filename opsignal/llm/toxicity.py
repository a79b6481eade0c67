"""Toxicity: cumulative-link ordinal regression on which words and word beginnings a text has.

P(grade > k) = sigmoid(w.x - t_k): one weight per feature for all thresholds t_1 <= t_2 <= ..., so severity is one
axis. Only features that a likelihood-ratio test ties to the grades get a weight.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal.llm.common import by_bytes, written

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Params:
    """sample: most labelled documents that the fit reads; least: documents of the sample that a feature must be in;
    tied: least likelihood ratio (G) of a feature; beginnings: lengths of the word beginnings; shrink: the absolute-value
    penalty; rounds and step: of the descent; split: with two grades only, whether the upper one is split in two at the
    median of its scores, so that severity has a scale that no label has; features: most features with a weight, those
    that are tied most; longest: characters of the longest feature that may have a weight."""

    sample: int = 10_000
    least: int = 5
    tied: float = 20.0
    beginnings: tuple[int, int] = (3, 8)
    shrink: float = 1e-5
    rounds: int = 600
    step: float = 0.5
    split: bool = False
    features: int = 4096
    longest: int = 64


@dataclass(frozen=True)
class Model:
    """weights: by feature; thresholds: of each grade above the lowest that the sample has; grades: all of them."""

    params: Params
    weights: dict[str, float]
    thresholds: tuple[float, ...]
    grades: tuple[int, ...]


def features(text: str | None, p: Params = Params()) -> set[str]:
    """Distinct words (letters only, in lower case) of a whole text, beginnings of longer ones, and the text's length class."""
    words = set(WORD.findall((text or "").lower()))
    low, high = p.beginnings
    out = {w[:k] + "-" for w in words for k in range(low, min(high, len(w) - 1) + 1)}
    return out | words | {f"#{len(words).bit_length()}"}


def _sample(docs: DataFrame, grades: DataFrame, p: Params) -> DataFrame:
    """grade, text of the graded ids with the smallest hashes, one row an id: of rows that repeat it, the shortest text."""
    ids = grades.filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample).select(F.col("doc_id").alias("id"), "grade")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))  # p.sample rows at most
    order = F.struct(F.octet_length("text"), F.xxhash64("text"))
    return written(found.groupBy("id", "grade").agg(F.min_by("text", order).alias("text")).select("grade", "text"), "sample")


def _tied_features(sample: DataFrame, lowest: int, n: int, n_upper: int, p: Params) -> list[str]:
    """Features that enough of the sample has and that tell the grades apart (G of their two-by-two table), and length classes."""

    def run(batches):
        for b in by_bytes(batches):
            found = [(f, g > lowest) for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in features(t, p) if len(f) <= p.longest]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([u for _, u in found], pa.bool_())], names=["name", "upper"])

    counts = sample.mapInArrow(run, "name string, upper boolean").groupBy("name").agg(F.count("*").alias("have"), F.count_if("upper").alias("up"))
    have, up, share = F.col("have"), F.col("up"), n_upper / n
    g = F.lit(0.0)
    for seen, expected in ((up, have * share), (have - up, have * (1 - share)), (n_upper - up, (n - have) * share), (n - have - (n_upper - up), (n - have) * (1 - share))):
        g = g + F.when(seen > 0, 2 * seen * F.log(seen / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)
    length = F.col("name").startswith("#")
    chosen = counts.withColumn("g", g).filter(length | ((have >= p.least) & (F.col("g") >= p.tied)))
    return sorted(r["name"] for r in chosen.orderBy(length.desc(), F.desc("g"), "name").limit(p.features).select("name").collect())


def _coded(sample: DataFrame, names: list[str], p: Params) -> pa.Table:
    """grade and the numbers of its features, for each row of the sample: p.sample times p.features numbers at most."""

    def run(batches):
        number = {f: k for k, f in enumerate(names)}
        for b in by_bytes(batches):
            rows = [sorted(number[f] for f in features(t, p) & number.keys()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["grade", "words"])

    return sample.mapInArrow(run, "grade int, words array<int>").toArrow()


def descend(rows: list[np.ndarray], level: np.ndarray, steps: int, p: Params, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. rows: column numbers of each row; level: 0 to steps."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    cols = np.concatenate(rows) if n else np.zeros(0, dtype=np.int64)
    above = np.array([(level > k).mean() for k in range(steps)])
    first, gaps = -np.log(above[0] / (1 - above[0])), np.zeros(steps)
    logit = -np.log(above / (1 - above))
    gaps[1:] = np.log(np.maximum(np.diff(logit), 1e-3))
    w, seen, seen_first, seen_gaps = np.zeros(words), np.full(words, 1e-8), 1e-8, np.full(steps, 1e-8)
    for _ in range(p.rounds):
        widths = np.where(np.arange(steps) > 0, np.exp(gaps), 0.0)
        limit = first + np.cumsum(widths)
        z = np.bincount(at, weights=w[cols], minlength=n)
        q = 1 / (1 + np.exp(-np.clip(z[:, None] - limit, -40, 40)))
        up = np.concatenate([np.ones((n, 1)), q, np.zeros((n, 1))], axis=1)
        take = np.arange(n)
        mass = np.maximum(up[take, level] - up[take, level + 1], 1e-9)
        d = up * (1 - up)
        by_limit = np.zeros((n, steps))  # slope of -log(mass) by each threshold
        has = level > 0
        by_limit[take[has], level[has] - 1] += (d[take, level] / mass)[has]
        has = level < steps
        by_limit[take[has], level[has]] -= (d[take, level + 1] / mass)[has]
        by_limit /= n
        slope = np.bincount(cols, weights=-by_limit.sum(axis=1)[at], minlength=words)
        seen += slope**2
        rate = p.step / np.sqrt(seen)
        w -= rate * slope
        w = np.sign(w) * np.maximum(np.abs(w) - rate * p.shrink, 0)
        total = by_limit.sum(axis=0)
        by_gap = np.cumsum(total[::-1])[::-1] * widths
        seen_first += total.sum() ** 2
        seen_gaps += by_gap**2
        first -= p.step * total.sum() / np.sqrt(seen_first)
        gaps -= p.step * by_gap / np.sqrt(seen_gaps)
    return w, first + np.cumsum(np.where(np.arange(steps) > 0, np.exp(gaps), 0.0))


def fit(docs: DataFrame, grades: DataFrame, params: Params = Params()) -> Model:
    """Fits on the documents of params.sample graded ids, those with the smallest hashes.

    docs: doc_id, text; grades: doc_id, grade (int, 0 lowest; null grades are left out, of several the highest counts).
    Only grades that the sample has get thresholds. With fewer than two grades the model has none and gives every text
    the one grade, or 0. The sample's features are counted by Spark; the driver gets the chosen ones and their numbers in
    each document of the sample, at most params.sample times params.features, however long the texts and whatever the ids.
    """
    sample = _sample(docs, grades, params)
    sizes = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    kinds = sorted(sizes)
    if len(kinds) < 2:
        return Model(params, {}, (), tuple(kinds) or (0,))
    n = sum(sizes.values())
    names = _tied_features(sample, kinds[0], n, n - sizes[kinds[0]], params)
    got = _coded(sample, names, params)
    words = got["words"].combine_chunks()
    ends = words.offsets.to_numpy()
    rows = np.split(words.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64), (ends - ends[0])[1:-1])
    level = np.searchsorted(kinds, got["grade"].to_numpy().astype(np.int64))
    w, limits = descend(rows, level, len(kinds) - 1, params, len(names))
    if params.split and len(kinds) == 2:
        z = np.array([w[r].sum() for r in rows])
        upper = z > np.median(z[level == 1])
        if (upper & (level == 1)).any():
            kinds.append(kinds[-1] + 1)
            w, limits = descend(rows, level + (upper & (level == 1)), 2, params, len(names))
    weights = {f: float(x) for f, x in zip(names, w, strict=True) if x}
    return Model(params, weights, tuple(map(float, limits)), tuple(kinds))


class Scorer:
    """Sums of a model's weights. Only words that start as some weighted feature does are looked at closely."""

    def __init__(self, model: Model):
        self.weights, (self.low, self.high) = model.weights, model.params.beginnings
        self.starts = {f[: self.low] for f in model.weights}

    def __call__(self, text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        low, high, starts, weights = self.low, self.high, self.starts, self.weights
        maybe = [w for w in words if w[:low] in starts]
        own = {w[:k] + "-" for w in maybe for k in range(low, min(high, len(w) - 1) + 1)} | set(maybe)
        own.add(f"#{len(words).bit_length()}")
        return sum(weights[f] for f in sorted(own & weights.keys()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, toxic, severity, expected_severity, p_toxic for each row of docs (doc_id, text; others are ignored).

    p_toxic: P(grade above the lowest); toxic: that is 0.5 or more; severity: the most probable grade, the lower of
    equals; expected_severity: the mean grade under the model. A null or empty text has no words and gets the
    thresholds' answer. Whole texts count; repeated rows are scored alike; no rows give no rows. A narrow map: no shuffle.
    """
    schema = "doc_id long, toxic boolean, severity int, expected_severity double, p_toxic double"

    def run(batches):
        scorer = Scorer(model)
        limits, grades = np.array(model.thresholds), np.array(model.grades, dtype=float)
        for b in by_bytes(batches):
            z = np.array([scorer(t) for t in b.column(1).to_pylist()])
            up = 1 / (1 + np.exp(-np.clip(z[:, None] - limits, -40, 40)))
            mass = np.concatenate([np.ones((len(z), 1)), up], axis=1) - np.concatenate([up, np.zeros((len(z), 1))], axis=1)
            p = up[:, 0] if len(limits) else np.full(len(z), float(grades[0] > 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p >= 0.5), pa.array(grades[mass.argmax(axis=1)].astype(np.int32)), pa.array(mass @ grades), pa.array(p)],
                names=["doc_id", "toxic", "severity", "expected_severity", "p_toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def severity_grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade from labels (doc_id, toxic): 0 not toxic, 1 toxic. Labels of more grades give more thresholds."""
    return labels.select("doc_id", F.col("toxic").cast("int").alias("grade"))
