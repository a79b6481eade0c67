"""Time-aware joins and label-set matching.

Every join here is an equi join (on a key plus a time cell), so Spark hashes or sorts and AQE can
split skewed partitions; no plan contains a nested-loop join or a Cartesian product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsignal.functions.timecells import SECOND, as_col, epoch_us


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    t_left: str,
    t_right: str,
    lo_s: float,
    hi_s: float,
    spread: int = 1,
) -> DataFrame:
    """Pairs with equal keys and t_left + lo <= t_right < t_left + hi.

    Cells are as wide as the range, so a left row is copied to at most two cells and each pair meets
    once. The left side should be the sparse one (triggers); `spread` > 1 scatters the right rows of
    a hot (key, cell) over that many tasks and copies the left rows to each.
    """
    lo, hi = int(lo_s * SECOND), int(hi_s * SECOND)
    width = F.lit(hi - lo)
    tl, tr = epoch_us(t_left), epoch_us(t_right)
    cells = F.sequence(F.floor((tl + lo) / width), F.floor((tl + (hi - 1)) / width))
    left2 = left.withColumn("_cell", F.explode(cells))
    right2 = right.withColumn("_cell", F.floor(tr / width))
    on = [*keys, "_cell"]
    if spread > 1:
        left2 = left2.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        right2 = right2.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in right.columns if c not in keys]), F.lit(spread)).cast("int"))
        on.append("_salt")
    pairs = left2.join(right2, on)
    return pairs.filter((tr >= tl + lo) & (tr < tl + hi)).drop("_cell", "_salt")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    t_left: str,
    t_right: str,
    take: list[str],
    direction: str = "backward",
    inclusive: bool = False,
    max_age_s: float | None = None,
    chunk_s: int = 3600,
    spread: int = 1,
) -> DataFrame:
    """Each left row with the nearest right row of its key before (or after) t_left.

    One ordered pass over both sides, never all pairs. The pass runs per (key, chunk of time), so a
    hot key is split; what the chunk starts with is carried from the last earlier chunk that has
    right rows (one row per key and chunk, found by a partial aggregate). With `spread` > 1 the left
    rows of a chunk are scattered over that many tasks and the right rows copied to each: use it when
    the left side is the crowded one. Ties on time take the greatest row of `take`. Left rows without
    a match keep nulls.
    """
    sign = 1 if direction == "backward" else -1
    probe = epoch_us(t_left) * sign
    stamp = epoch_us(t_right) * sign
    chunk = F.lit(chunk_s * SECOND)
    match = F.struct(stamp.alias("s"), F.struct(*take).alias("row"))

    lrows = left.withColumn("_t", probe).withColumn("_chunk", F.floor(F.col("_t") / chunk))
    rrows = right.select(*keys, stamp.alias("_t"), match.alias("_m")).withColumn("_chunk", F.floor(F.col("_t") / chunk))

    ends = rrows.groupBy(*keys, "_chunk").agg(F.max("_m").alias("_m"))
    marks = ends.unionByName(lrows.select(*keys, "_chunk").distinct(), allowMissingColumns=True)
    marks = marks.groupBy(*keys, "_chunk").agg(F.max("_m").alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_m", F.last("_m", ignorenulls=True).over(earlier)).filter(F.col("_m").isNotNull())

    # Order inside a chunk: carried row, then right rows before (inclusive) or after equal left rows.
    side_right = 0 if inclusive else 2
    right_all = rrows.withColumn("_side", F.lit(side_right)).unionByName(
        carried.withColumn("_t", F.col("_chunk") * chunk).withColumn("_side", F.lit(-1))
    )
    parts = [*keys, "_chunk"]
    if spread > 1:
        parts.append("_salt")
        lrows = lrows.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(spread)).cast("int"))
        right_all = right_all.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    rows = lrows.withColumn("_side", F.lit(1)).unionByName(right_all, allowMissingColumns=True)
    order = Window.partitionBy(*parts).orderBy("_t", "_side", "_m").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_m", F.last("_m", ignorenulls=True).over(order)).filter(F.col("_side") == 1)
    if max_age_s is not None:
        fresh = F.col("_t") - F.col("_m.s") <= int(max_age_s * SECOND)
        found = found.withColumn("_m", F.when(fresh, F.col("_m")))
    return found.select(*left.columns, *[F.col(f"_m.row.{c}").alias(c) for c in take])


def exists_between(
    left: DataFrame, right: DataFrame, keys: list[str], t_left: str, t_right: str, lo_s: float, hi_s: float, flag: str
) -> DataFrame:
    """True where a right row of the key lies in [t_left + lo, t_left + hi], both ends included.

    With cells as wide as the range, a range starts in one cell and ends in the next, never inside the
    same one. So the first and last right time of the start cell and the first of the next cell decide
    the answer: the right side shrinks to one row per (key, cell) before a single equi join, and no
    pairs are formed.
    """
    lo, hi = int(lo_s * SECOND), int(hi_s * SECOND)
    width = F.lit(max(hi - lo, 1))
    tr = epoch_us(t_right)
    own = F.floor(tr / width)
    none = F.lit(None).cast("bigint")
    sides = F.array(
        F.struct(own.alias("c"), tr.alias("lo"), tr.alias("hi"), none.alias("next")),
        F.struct((own - 1).alias("c"), none.alias("lo"), none.alias("hi"), tr.alias("next")),
    )
    cells = right.select(*keys, F.explode(sides).alias("_e")).groupBy(*keys, F.col("_e.c").alias("_cell")).agg(
        F.min("_e.lo").alias("_lo"), F.max("_e.hi").alias("_hi"), F.min("_e.next").alias("_next")
    )
    start = epoch_us(t_left) + lo
    rows = left.withColumn("_a", start).withColumn("_cell", F.floor(F.col("_a") / width)).join(cells, [*keys, "_cell"], "left")
    end = F.col("_a") + (hi - lo)
    hit = ((F.col("_hi") >= F.col("_a")) & (F.col("_lo") <= end)) | F.coalesce(F.col("_next") <= end, F.lit(False))
    return rows.select(*left.columns, F.coalesce(hit, F.lit(False)).alias(flag))


def near_event_flag(
    left: DataFrame, right: DataFrame, keys: list[str], t_left: str, t_right: str, radius_s: float, flag: str
) -> DataFrame:
    """True where a right row of the key lies within +-radius of the left row."""
    return exists_between(left, right, keys, t_left, t_right, -radius_s, radius_s, flag)


def either_key(df: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """One row per distinct value of two key columns, so an OR of equalities becomes an equi join."""
    return df.withColumn(key, F.explode(F.array_distinct(F.array(first, second))))


# --- label sets ---------------------------------------------------------------------------------
def label_key(labels: Column | str, on: list[str] | None = None, ignoring: list[str] | None = None) -> Column:
    """Comparable form of a label set: sorted entries of the labels kept."""
    c = as_col(labels)
    if on is not None:
        c = F.map_filter(c, lambda k, v: k.isin(on))
    elif ignoring is not None:
        c = F.map_filter(c, lambda k, v: ~k.isin(ignoring))
    return F.array_sort(F.map_entries(c))


def vector_match(
    left: DataFrame, right: DataFrame, on: list[str] | None = None, ignoring: list[str] | None = None
) -> DataFrame:
    """Join two instant vectors (labels, value) on a label subset; many left rows to one right row."""
    lv = left.withColumn("_lk", label_key("labels", on, ignoring))
    rv = right.select(label_key("labels", on, ignoring).alias("_lk"), F.col("value").alias("right_value"))
    return lv.join(rv, "_lk").drop("_lk")


def vector_and(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    keep = right.select(label_key("labels", on).alias("_lk"))
    return left.withColumn("_lk", label_key("labels", on)).join(keep, "_lk", "left_semi").drop("_lk")


def vector_or(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """All of left, and those of right whose label set left does not have."""
    have = left.select(label_key("labels", on).alias("_lk"))
    extra = right.withColumn("_lk", label_key("labels", on)).join(have, "_lk", "left_anti").drop("_lk")
    return left.unionByName(extra)


def vector_not_equal(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return vector_match(left, right, on=on).filter(F.col("value") != F.col("right_value"))


def aggregate_labels(
    df: DataFrame, aggs: list[Column], by: list[str] | None = None, without: list[str] | None = None
) -> DataFrame:
    """Aggregate samples over a label subset: keep `by`, or drop `without`."""
    grouped = df.groupBy(label_key("labels", by, without).alias("_lk")).agg(*aggs)
    return grouped.withColumn("labels", F.map_from_entries("_lk")).drop("_lk")
