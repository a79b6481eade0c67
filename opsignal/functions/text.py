"""String, JSON, label and hash expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsignal import fixed_values as fv
from opsignal.functions.timecells import as_col, epoch_us


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False)) if conds else F.lit(False)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True)) if conds else F.lit(True)


def last_match(pairs: list[tuple[Column, Column | str]], default: Column | str | None) -> Column:
    """Chain of conditions where a later match overrides an earlier one."""
    out = F.lit(default) if not isinstance(default, Column) else default
    for cond, value in pairs:
        out = F.when(cond, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def full_match(c: Column | str, pattern: str) -> Column:
    return as_col(c).rlike(f"^(?:{pattern})$")


def label(labels: Column | str, key: str) -> Column:
    """Value of a label; a missing label reads as the empty string."""
    return F.coalesce(as_col(labels).getItem(key), F.lit(""))


def label_matches(value: Column, op: str, operand: str) -> Column:
    if op == "=":
        return value == operand
    if op == "!=":
        return value != operand
    if op == "=~":
        return full_match(value, operand)
    if op == "!~":
        return ~full_match(value, operand)
    raise ValueError(f"unknown label operator {op}")


def _string_field(variant: Column, key: str) -> Column:
    """A JSON field, only if it is a non-blank string."""
    text = F.try_variant_get(variant, f"$.{key}", "string")
    is_string = F.schema_of_variant(F.try_variant_get(variant, f"$.{key}", "variant")) == "STRING"
    return F.when(is_string & (F.trim(text) != ""), text)


def message_text(line: Column | str, max_chars: int | None = None) -> Column:
    """Human-readable message of a log line: nested body fields, then outer fields, then the line."""
    raw = F.trim(as_col(line))
    outer = F.when(raw.startswith("{"), F.try_parse_json(raw))
    body = F.try_variant_get(outer, "$.body", "string")
    inner = F.when(F.ltrim(body).startswith("{"), F.try_parse_json(body))
    picked = F.coalesce(
        *[_string_field(inner, k) for k in fv.INNER_MESSAGE_KEYS],
        *[_string_field(outer, k) for k in fv.OUTER_MESSAGE_KEYS],
        raw,
    )
    return F.left(picked, F.lit(max_chars)) if max_chars else picked


def mask_variables(c: Column | str) -> Column:
    """Replace UUIDs, IPv4 addresses, long hex runs and numbers by <*>."""
    out = as_col(c)
    for pattern in (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
        r"\b[0-9a-fA-F]{8,}\b",
        r"[0-9]+",
    ):
        out = F.regexp_replace(out, pattern, "<*>")
    return out


def pattern_id(ns: Column | str, template: Column | str) -> Column:
    """First 64 bits of md5(namespace:template), as hex."""
    return F.left(F.md5(F.concat_ws(":", as_col(ns), as_col(template))), F.lit(16))


def event_hash(rule_id: Column | str, ns: Column | str, ts: Column | str) -> Column:
    """Deduplication key: rule, namespace and minute; first 64 bits of sha256, as hex."""
    minute = F.floor(epoch_us(ts) / F.lit(60_000_000)).cast("string")
    return F.left(F.sha2(F.concat_ws(":", as_col(rule_id), as_col(ns), minute), 256), F.lit(16))


def first_technique_tag(tags: Column | str) -> Column:
    """First tag naming a technique, '' if there is none."""
    hits = F.filter(as_col(tags), lambda t: t.rlike(fv.TECHNIQUE_TAG_PATTERN))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))


def namespace_of(service: Column | str) -> Column:
    return F.split_part(as_col(service), F.lit("/"), F.lit(1))
