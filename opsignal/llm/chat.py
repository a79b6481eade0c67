"""Chat formatting: turn order by a finite-state machine, text segments with loss flags from a declarative template.

Everything is a DataFrame expression; nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How one role is written: `open` text `close`; loss tells whether the text is trained on."""

    open: str
    close: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """Marks of turns, the role machine, and the control strings that no text may hold unescaped.

    Control strings start with `<` or `[`. Inside texts `&` becomes `&amp;` and the first character of each control
    string becomes an entity, so a text never holds a control string and every text can be restored.
    Marks begin or end with a space beside the text; as no control string holds a space, none can arise where
    a text meets a mark.
    """

    turns: dict[str, Turn]
    other: Turn
    other_text: str
    between: str
    control: tuple[str, ...]
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    final: tuple[str, ...] = ()


ENTITIES = {"<": "&lt;", "[": "&lbr;"}

DEFAULT = Template(
    turns={
        "system": Turn("<<SYS>> ", " <</SYS>>", False),
        "user": Turn("[INST] ", " [/INST]", False),
        "assistant": Turn("<s> ", " </s>", True),
    },
    other=Turn("[ROLE] ", " [/ROLE]", False),
    other_text=" [TEXT] ",
    between="\n",
    control=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]"),
    moves={
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    },
    final=("assistant",),
)


def escape(col: Column, template: Template = DEFAULT) -> Column:
    col = F.replace(col, F.lit("&"), F.lit("&amp;"))
    for mark in template.control:
        col = F.replace(col, F.lit(mark), F.lit(ENTITIES[mark[0]] + mark[1:]))
    return col


def unescape(col: Column) -> Column:
    for char, entity in ENTITIES.items():
        col = F.replace(col, F.lit(entity), F.lit(char))
    return F.replace(col, F.lit("&amp;"), F.lit("&"))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in text)


def _written(role: Column, text: Column, template: Template) -> Column:
    body = escape(text, template)
    out = F.concat(F.lit(template.other.open), escape(role, template), F.lit(template.other_text), body, F.lit(template.other.close))
    for name, t in template.turns.items():
        out = F.when(role == name, F.concat(F.lit(t.open), body, F.lit(t.close))).otherwise(out)
    return out


def _one_of(role: Column, values: dict[str, object], default: object) -> Column:
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(role == name, F.lit(v)).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conv_id: conv_id, formatted string, segments, valid, bad_turn.

    rows: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, then role, then text, nulls
    first, so ties have one order; repeated rows are turns of their own. A null text or role is the empty string, null
    conv_ids are one conversation. segments: array of (role, start, length, loss) with byte offsets of the escaped
    texts in the UTF-8 of formatted. valid: the roles run through the machine to a final state; bad_turn: index of
    the first turn that has no move, null if there is none. Roles that the template doesn't name are written with its
    marks for other roles, carry no loss and have no move. No rows give no rows.

    A conversation is one output value, so its turns meet in one task, as many as the conversation has.
    """
    turns = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    piece = _written(F.col("role"), F.col("text"), template)
    ahead = F.coalesce(
        _one_of(F.col("role"), {n: len(t.open.encode()) for n, t in template.turns.items()}, None),
        F.octet_length(escape(F.col("role"), template)) + len((template.other.open + template.other_text).encode()),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        turns.select("*", piece.alias("piece"), ahead.alias("ahead"), F.octet_length(escape(F.col("text"), template)).alias("length"))
        .select(
            "conv_id", "role", "piece", "length", F.row_number().over(order).alias("at"),
            (F.coalesce(F.sum(F.octet_length("piece") + len(template.between.encode())).over(before), F.lit(0)) + F.col("ahead")).alias("start"),
        )
    )
    loss = _one_of(F.col("role"), {n: t.loss for n, t in template.turns.items()}, template.other.loss)
    packed = laid.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece", "role", "start", "length", loss.alias("loss")))).alias("t")
    )
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}>{role}", to)])
    run = F.aggregate(
        F.col("t"),
        F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("bad")),
        lambda s, x: F.struct(
            F.coalesce(F.try_element_at(moves, F.concat(s["state"], F.lit(">"), x["role"])), F.lit("error")).alias("state"),
            F.coalesce(s["bad"], F.when(F.try_element_at(moves, F.concat(s["state"], F.lit(">"), x["role"])).isNull(), x["at"] - 1)).alias("bad"),
        ),
    )
    return packed.select("conv_id", "t", run.alias("run")).select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), template.between).alias("formatted"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["start"].alias("start"), x["length"].alias("length"), x["loss"].alias("loss"))).alias("segments"),
        F.col("run.state").isin(*template.final).alias("valid"),
        F.col("run.bad").alias("bad_turn"),
    )


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """array of (role, text), parsed from the formatted string alone."""
    marks = [(n, t.open, t.close) for n, t in template.turns.items()] + [(None, template.other.open, template.other.close)]
    pattern = "(?s)" + "|".join(f"{_quoted(o)}.*?{_quoted(c)}" for _, o, c in marks)

    def parsed(x: Column) -> Column:
        rest = F.substring(x, F.lit(len(template.other.open) + 1), F.char_length(x) - len(template.other.open + template.other.close))
        out = F.struct(
            unescape(F.substring_index(rest, template.other_text, 1)).alias("role"),
            unescape(F.substring(rest, F.instr(rest, template.other_text) + len(template.other_text), F.char_length(rest))).alias("text"),
        )
        for n, o, c in marks[:-1]:
            inner = F.substring(x, F.lit(len(o) + 1), F.char_length(x) - len(o + c))
            out = F.when(F.startswith(x, F.lit(o)), F.struct(F.lit(n).alias("role"), unescape(inner).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), parsed)


def loss_text(formatted: Column, segments: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    raw = formatted.cast("binary")
    return F.array_join(
        F.transform(
            F.filter(segments, lambda s: s["loss"]),
            lambda s: unescape(F.substring(raw, s["start"].cast("int") + 1, s["length"]).cast("string")),
        ),
        "",
    )


def summary(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the formatted string and its segments."""
    back = formatted.select("*", read_back(F.col("formatted"), template).alias("turns"), loss_text(F.col("formatted"), F.col("segments")).alias("trained"))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        F.col("bad_turn").cast("bigint").alias("bad_turn"),
    )
