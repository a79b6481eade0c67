"""Log templates: declarative mining, ids, novelty, frequency and proximity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.text import mask_variables, pattern_id
from opsignal.functions.timecells import SECOND, cell, epoch_us, from_epoch_us
from opsignal.operators.joins import near_event_flag

ANY = "<*>"


def _late(cond: Column) -> Column:
    """cond as a filter on rows of masked_lines that needs the count and time of a line, though every row has them.

    So it stays above the reduction, and each line is masked once; and all readers of the rows need the same columns, so that
    they share one exchange.
    """
    return F.when((F.col("cnt") > 0) | F.col("first_seen").isNull(), cond)


def masked_lines(df: DataFrame, keys: list[str], line: str, ts: str) -> DataFrame:
    """Distinct masked lines with their count and first time; the reduction happens before the shuffle."""
    text = F.regexp_replace(F.trim(mask_variables(line)), r"\s+", " ")
    counted = df.select(*keys, text.alias("masked"), F.col(ts).alias("_ts")).groupBy(*keys, "masked").agg(
        F.count("*").alias("cnt"), F.min("_ts").alias("first_seen")
    )
    return counted.filter(_late(F.col("masked") != ""))


def mine_templates(
    df: DataFrame, keys: list[str], line: str, ts: str, max_values: int = 5, max_share: float = 0.4
) -> DataFrame:
    """Templates of log lines: (keys, template, samples_count, first_seen, pattern_id).

    Lines of a group (keys, token count, first token) differ at some positions. A position becomes
    <*> when it has more than max_values distinct tokens and those are more than max_share of the
    group's distinct lines. Everything is grouped aggregation on distinct lines: order-free, whole
    lines, nothing sampled. Distinct lines are dealt by group once; tokens are counted where the lines
    lie, and only in groups of more than max_values lines, as others can't have more values. The open
    positions come back as one array per group.
    """
    words = F.split("masked", " ")
    # One key that is never null: for others the join adds a filter, and the two sides aren't the same exchange any more.
    group = F.struct(*keys, F.size(words).alias("_len"), F.substring_index("masked", " ", 1).alias("_head"))
    lines = masked_lines(df, keys, line, ts).select(group.alias("_g"), "masked", "cnt", "first_seen").repartition("_g")
    crowded = lines.withColumn("_n", F.count("*").over(Window.partitionBy("_g"))).filter(_late(F.col("_n") > max_values))
    tokens = crowded.select("_g", "_n", F.posexplode(words).alias("_pos", "_token"))
    per_pos = tokens.distinct().groupBy("_g", "_n", "_pos").agg(F.count("*").alias("_values"))
    varies = (F.col("_values") > max_values) & (F.col("_values") > max_share * F.col("_n"))
    open_positions = per_pos.filter(varies).groupBy("_g").agg(F.collect_set("_pos").alias("_open"))
    joined = lines.join(open_positions, "_g", "left")
    opened = F.transform(words, lambda t, i: F.when(F.array_contains("_open", i), F.lit(ANY)).otherwise(t))
    # groups without a key keep their lines as they are
    plain = reduce(lambda a, b: a | b, [F.col(f"_g.{k}").isNull() for k in keys], F.col("_open").isNull())
    template = F.when(plain, F.col("masked")).otherwise(F.array_join(opened, " "))
    out = joined.groupBy(*[F.col(f"_g.{k}").alias(k) for k in keys], template.alias("template")).agg(
        F.sum("cnt").alias("samples_count"), F.min("first_seen").alias("first_seen")
    )
    return out.withColumn("pattern_id", pattern_id(keys[0], "template"))


def enrich_patterns(
    patterns: DataFrame, keys: list[str], bucket: str, known: DataFrame, security: DataFrame, radius_s: float = 300,
    factor: float = fv.FREQUENCY_FACTOR,
) -> DataFrame:
    """Add is_novel, is_freq_anomaly and security_correlated to the patterns of each bucket.

    patterns has one row per (keys, pattern, bucket). The baseline of a bucket is the mean count over
    the earlier buckets of the pattern. known(pattern_id, known_since): novel when not known before
    the bucket. Only novel patterns are checked for a security event nearby.
    """
    earlier = Window.partitionBy(*keys, "pattern_id").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    rows = patterns.withColumn("avg_count", F.coalesce(F.avg("samples_count").over(earlier), F.lit(0.0)))
    since = known.groupBy("pattern_id").agg(F.min("known_since").alias("_since"))
    rows = rows.join(since, "pattern_id", "left")
    novel = F.col("_since").isNull() | (F.col("_since") >= F.col(bucket))
    rows = rows.withColumn("is_novel", novel).withColumn(
        "is_freq_anomaly", (F.col("avg_count") > 0) & (F.col("samples_count") > factor * F.col("avg_count"))
    ).drop("_since")
    near = near_event_flag(rows, security, keys, "first_seen", "seen_at", radius_s, "_near")
    return near.withColumn("security_correlated", F.col("is_novel") & F.col("_near")).drop("_near")


def register_novel(enriched: DataFrame, bucket: str) -> DataFrame:
    """Rows to append to the known-pattern store."""
    return enriched.filter("is_novel").groupBy("pattern_id").agg(
        F.min("template").alias("template"), F.min(bucket).alias("known_since")
    )


def pattern_label_counts(df: DataFrame, keys: list[str], labels: str) -> DataFrame:
    """Lines per pattern label, else level label, else 'unknown'."""
    lab = F.col(labels)
    name = F.coalesce(F.nullif(lab["pattern"], F.lit("")), lab["detected_level"], F.lit("unknown"))
    return df.groupBy(*keys, name.alias("template")).agg(F.count("*").alias("cnt"))


def novel_sightings(sightings: DataFrame, expire_s: int = 30 * 86400) -> DataFrame:
    """pattern_id, first_seen: when a pattern is seen that isn't known, as it is new or was away for longer than expire_s.

    sightings(pattern_id, ts), by whole seconds. Inside a cell as wide as expire_s a pattern can't be away for longer, so each
    cell is one row, with its first and last sighting, before the rows of a pattern are ordered.
    """
    at = F.floor(epoch_us("ts") / F.lit(SECOND)) * F.lit(SECOND)
    cells = sightings.groupBy("pattern_id", cell("ts", expire_s).alias("_c")).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    away = F.col("lo") - F.lag("hi").over(Window.partitionBy("pattern_id").orderBy("_c"))
    fresh = cells.select("pattern_id", "lo", away.alias("away")).filter(F.col("away").isNull() | (F.col("away") > expire_s * SECOND))
    return fresh.select("pattern_id", from_epoch_us(F.col("lo")).alias("first_seen"))
