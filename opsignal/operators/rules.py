"""Rules as data: conditions over named selections, field names and log sources, compiled to one scan."""

from __future__ import annotations

import re
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsignal.functions.text import all_of, any_of, first_technique_tag
from opsignal.operators.detect import field_condition

WORD = re.compile(r"\s*(\(|\)|[\w.*-]+)")


def parse_condition(text: str, names: list[str]):
    """The tree of a condition: a selection's name, ("not", x), ("and", ...) or ("or", ...).

    `not` binds before `and`, `and` before `or`; `1 of`, `any of` and `all of` take a pattern with `*` or `them`
    (all selections that don't begin with `_`). Names that no selection has, and patterns that fit none, are errors.
    """
    words, at = [], 0
    while at < len(text.rstrip()):
        found = WORD.match(text, at)
        if found is None:
            raise ValueError(f"condition {text!r}: unexpected character at {at}")
        words.append(found.group(1))
        at = found.end()
    words.reverse()  # the next word is the last one

    def either():
        parts = [both()]
        while words and words[-1].lower() == "or":
            words.pop()
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def both():
        parts = [single()]
        while words and words[-1].lower() == "and":
            words.pop()
            parts.append(single())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def single():
        if not words:
            raise ValueError(f"condition {text!r} ends too early")
        word = words.pop()
        if word.lower() == "not":
            return ("not", single())
        if word == "(":
            inner = either()
            if not words or words.pop() != ")":
                raise ValueError(f"condition {text!r}: a bracket isn't closed")
            return inner
        if word.lower() in ("1", "any", "all") and words and words[-1].lower() == "of":
            words.pop()
            if not words:
                raise ValueError(f"condition {text!r} ends too early")
            pattern = words.pop()
            fitting = [n for n in names if (not n.startswith("_") if pattern == "them" else fnmatchcase(n, pattern))]
            if not fitting:
                raise ValueError(f"condition {text!r}: no selection fits {pattern!r}")
            return fitting[0] if len(fitting) == 1 else ("and" if word.lower() == "all" else "or", *fitting)
        if word not in names:
            raise ValueError(f"condition {text!r}: no selection {word!r}")
        return word

    tree = either()
    if words:
        raise ValueError(f"condition {text!r}: {words[-1]!r} is left over")
    return tree


def detection_column(detection: dict, field) -> Column:
    """A rule's detection as a Column; field: name -> Column. A selection is a dict (all fields) or a list of dicts (any)."""
    bodies = {n: b for n, b in detection.items() if n != "condition"}

    def one(body: dict) -> Column:
        return all_of([field_condition(f, v, {f.partition("|")[0]: field(f.partition("|")[0])}) for f, v in body.items()])

    def build(node) -> Column:
        if isinstance(node, str):
            body = bodies[node]
            return any_of([one(b) for b in body]) if isinstance(body, list) else one(body)
        op, *args = node
        parts = [build(a) for a in args]
        return ~parts[0] if op == "not" else all_of(parts) if op == "and" else any_of(parts)

    return build(parse_condition(detection["condition"], list(bodies)))


def line_column(lines: dict, line: Column, event_class: Column) -> Column:
    """Expressions that a line must hold (all) or mustn't (none), in lines of some classes."""
    parts = [event_class.isin(lines["event_class"]), *(line.rlike(e) for e in lines["all"]), *(~line.rlike(e) for e in lines.get("none", []))]
    return F.coalesce(all_of(parts), F.lit(False))


def source_attributes(logsource: dict, sources: list[tuple[dict, dict]]) -> dict:
    """Attributes of the first source whose product, service and category the rule names."""
    for where, attributes in sources:
        if all(logsource.get(k) == v for k, v in where.items()):
            return attributes
    return {}


def match_shipped(df: DataFrame, rules: list[dict], sources: list[tuple[dict, dict]], field_names: dict[str, str], keep: list[str]) -> DataFrame:
    """keep, rule_id, rule_title, rule_level, rule_tags, mitre: one row per row of df and rule that it meets.

    df: attributes and fields (maps of strings), line, event_class. A rule with `lines` looks at lines, any other at the fields of
    records that its log source names. One scan: each field that a rule names is read from its map once per row, and a row is
    held only against the rules of its own source. Missing fields meet nothing but a `not`.
    """
    by_source: dict[tuple, list[dict]] = {}
    for r in rules:
        attributes = {} if "lines" in r else source_attributes(r["logsource"], sources)
        if "lines" not in r and not attributes:
            raise ValueError(f"rule {r['id']}: no source for {r['logsource']}")
        by_source.setdefault(tuple(sorted(attributes.items())), []).append(r)
    used = sorted({
        f.partition("|")[0] for r in rules if "lines" not in r for n, body in r["detection"].items() if n != "condition"
        for b in (body if isinstance(body, list) else [body]) for f in b
    })
    read = df.select(
        *keep, "line", "event_class", "attributes", *[F.try_element_at("fields", F.lit(field_names.get(f, f))).alias(f"_f_{f}") for f in used]
    )

    def hit(r: dict) -> Column:
        where = line_column(r["lines"], F.col("line"), F.col("event_class")) if "lines" in r else detection_column(r["detection"], lambda f: F.col(f"_f_{f}"))
        return F.when(where, F.struct(
            F.lit(r["id"]).alias("rule_id"), F.lit(r["title"]).alias("rule_title"), F.lit(r["level"]).alias("rule_level"),
            F.array(*[F.lit(t) for t in r["tags"]]).cast("array<string>").alias("rule_tags"),
        ))

    parts = []
    for attributes, own in by_source.items():
        hits = F.array_compact(F.array(*[hit(r) for r in own]))
        here = all_of([F.coalesce(F.try_element_at("attributes", F.lit(k)) == v, F.lit(False)) for k, v in attributes]) if attributes else None
        parts.append(hits if here is None else F.when(here, hits))
    none = F.array().cast("array<struct<rule_id:string,rule_title:string,rule_level:string,rule_tags:array<string>>>")
    found = read.select(*keep, F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("_r")).select(*keep, "_r.*")
    return found.withColumn("mitre", first_technique_tag("rule_tags"))
