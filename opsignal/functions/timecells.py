"""Epoch arithmetic and time cells.

A *cell* is an integer index of a fixed-width slice of time.  Operators that need time order
work on cells, not on raw rows: rows are first reduced to one row per (key, cell) with partial
aggregation, so the ordered pass sees at most span/width rows per key however hot the key is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60
HOUR = 3600
DAY = 86400


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(c: Column | str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column (session zone UTC)."""
    return F.unix_micros(as_col(c).cast("timestamp"))


def from_epoch_us(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def cell(c: Column | str, width_s: int) -> Column:
    """Left-closed cell [i*w, (i+1)*w)."""
    return F.floor(epoch_us(c) / F.lit(width_s * SECOND)).cast("bigint")


def eval_cell(c: Column | str, step_s: int) -> Column:
    """Right-closed cell ((i-1)*w, i*w]: the first evaluation step that sees the sample."""
    return F.ceil(epoch_us(c) / F.lit(step_s * SECOND)).cast("bigint")


def cell_time(c: Column | str, width_s: int) -> Column:
    """Instant i*w: start of a left-closed cell, evaluation time of a right-closed one."""
    return from_epoch_us(as_col(c) * F.lit(width_s * SECOND))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (epoch_us(end) - epoch_us(start)) / F.lit(float(SECOND))


SPAN_UNITS = {"s": SECOND, "m": MINUTE * SECOND, "h": HOUR * SECOND, "d": DAY * SECOND}
SPAN = re.compile(r"\s*([1-9][0-9]*)\s*([smhd])\s*")


def timespan_seconds(text: str) -> int:
    """'15m' -> 900: a whole number and one of the units s, m, h, d. Anything else is an error."""
    parsed = SPAN.fullmatch(text)
    if parsed is None:
        raise ValueError(f"not a time span: {text!r}")
    number, unit = parsed.groups()
    return int(number) * SPAN_UNITS[unit] // SECOND


def whole_cells(range_s: int, cell_s: int) -> int:
    """How many cells make up a range; a range that they don't make up exactly is an error."""
    if range_s <= 0 or cell_s <= 0 or range_s % cell_s:
        raise ValueError(f"a range of {range_s} s is not a whole number of cells of {cell_s} s")
    return range_s // cell_s
