"""URL filter: host rules first, then logistic regression on hashed character n-grams of host and path.

Everything is a DataFrame expression. The driver holds the weights (`buckets` numbers), no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsignal.llm.common import lower_ascii, written


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Params:
    """buckets: hashed features; grams: n-gram lengths; rounds: gradient steps; labelled: most rows the fit reads."""

    buckets: int = 4096
    grams: tuple[int, ...] = (3, 4)
    rounds: int = 25
    step: float = 4.0
    decay: float = 1e-4
    labelled: int = 2000


@dataclass(frozen=True)
class Model:
    params: Params
    weights: tuple[float, ...]
    bias: float


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise(F.lit(""))
    return (
        lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits (ties: block first, then by name), or nulls.

    rules is a short list, a parameter.
    """
    name = action = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.action != "allow", r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, action = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.action)).otherwise(action)
    return name, action


def features(host: Column, path: Column, p: Params) -> Column:
    """Buckets (1-based) of all n-grams of ^host$ and ^path$, with repeats."""

    def grams(text: Column, kind: str, n: int) -> Column:
        whole = F.concat(F.lit(f"{kind}^"), text, F.lit("$"))
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(whole) - n)),
            lambda i: (F.pmod(F.xxhash64(F.concat(F.lit(kind), F.substring(whole, i + 1, F.lit(n)))), F.lit(p.buckets)) + 1).cast("int"),
        )

    return F.concat(*[grams(text, kind, n) for text, kind in ((host, "h"), (path, "p")) for n in p.grams])


def _weighed(idx: Column, weights: Sequence[float], bias: float) -> Column:
    w = F.from_json(F.lit(json.dumps(list(weights))), "array<double>")
    return F.aggregate(idx, F.lit(0.0), lambda s, i: s + F.element_at(w, i)) / F.sqrt(F.size(idx)) + bias


def _sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """Accelerated gradient descent on logistic loss over a small table (host, path, blocked).

    At most params.labelled distinct urls are read, in hash order. Rows with a null label are left out; no rows give
    a model that allows all. Each round sums the gradient on the executors, one number per bucket.
    """
    rows = labelled.filter(F.col("blocked").isNotNull()).select("host", "path", F.col("blocked").cast("double").alias("y")).distinct()
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "y").limit(params.labelled)
    rows = written(rows.select("y", features(F.col("host"), F.col("path"), params).alias("idx")), "urls")
    n = rows.count()
    w, at, bias, bias_at = [0.0] * params.buckets, [0.0] * params.buckets, 0.0, 0.0
    for k in range(params.rounds if n else 0):
        off = rows.select("idx", (_sigmoid(_weighed(F.col("idx"), at, bias_at)) - F.col("y")).alias("off"))
        spread = off.select(F.explode(F.concat(F.col("idx"), F.array(F.lit(0)))).alias("bucket"), "off", F.sqrt(F.size("idx")).alias("root"))
        slope = spread.groupBy("bucket").agg(F.sum(F.col("off") / F.when(F.col("bucket") > 0, F.col("root")).otherwise(1.0)).alias("s"))
        g = {r["bucket"]: r["s"] / n for r in slope.collect()}  # buckets + 1 rows at most
        new = [a - params.step * (g.get(i + 1, 0.0) + params.decay * a) for i, a in enumerate(at)]
        new_bias = bias_at - params.step * g.get(0, 0.0)
        pull = k / (k + 3)
        at, bias_at = [b + pull * (b - a) for a, b in zip(w, new)], new_bias + pull * (new_bias - bias)
        w, bias = new, new_bias
    return Model(params, tuple(0.0 if math.isnan(x) else x for x in w), bias)


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (the method's probability of block).

    One row per row, repeats included; other columns are ignored. A null or malformed url has empty host and path and
    gets the method's verdict for those.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, action = rule_for(F.col("host"), F.col("path"), rules)
    score = _sigmoid(_weighed(features(F.col("host"), F.col("path"), model.params), model.weights, model.bias))
    return rows.select("page_id", "host", "path", name.alias("rule"), action.alias("action"), score.alias("score")).select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """host, path, blocked: labels for the urls that a rule decides, from which the method learns to judge the rest."""
    host, path = parts(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"))
    _, action = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select("host", "path", (action == "block").alias("blocked")).filter(F.col("blocked").isNotNull())
