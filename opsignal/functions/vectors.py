"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsignal.functions.timecells import as_col


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision."""
    x, y = as_col(a).cast("array<double>"), as_col(b).cast("array<double>")
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
