"""Chat formatting by a declarative template and a finite-state machine over roles.

The template gives each role an opening, a closing and a loss flag, and the states the machine may
pass through.  Control strings inside texts are escaped with a backslash code each, so the
output can be read back exactly.  Everything is built from SQL functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.base import quoted

START = "start"


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Declares how turns are written and which role may follow which.

    ``roles``: the known roles.  ``moves``: state -> roles that may come next; the state is the last
    legal role.  ``final``: states in which a conversation may end.  A turn of any other role is
    written as opening, role, separator, text, closing by ``other``, without loss.
    """

    roles: dict[str, Role]
    moves: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    control: tuple[str, ...]
    other: tuple[str, str, str] = ("[TURN]", "[AS]", "[/TURN]")
    codes: str = field(default="acdefghijklmnopqrstuvwxyz")  # b stands for the backslash itself

    def __post_init__(self):
        assert len(self.control) <= len(self.codes), "too many control strings"
        assert not any("\\" in c for c in self.control), "a control string may hold no backslash"
        marks = [m for r in self.roles.values() for m in (r.opening, r.closing)] + list(self.other)
        for mark in marks:
            assert any(c in mark for c in self.control), f"{mark!r} holds no control string"


INSTRUCT = Template(
    roles={
        "system": Role("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Role("<s>[INST] ", " [/INST]"),
        "assistant": Role("[OUT] ", " </s>", loss=True),
    },
    moves={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("user", "assistant"),
    control=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "[TURN]", "[AS]", "[/TURN]", "<s>", "</s>"),
)


def escaped(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return reduce(
        lambda t, c: F.replace(t, F.lit(c[0]), F.lit("\\" + c[1])), zip(template.control, template.codes, strict=False), text
    )


def unescaped(text: Column, template: Template) -> Column:
    text = reduce(
        lambda t, c: F.replace(t, F.lit("\\" + c[1]), F.lit(c[0])), zip(template.control, template.codes, strict=False), text
    )
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _segment(text: Column, loss: Column | bool) -> Column:
    return F.struct(text.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))


def _segments(turn: Column, template: Template) -> Column:
    """One turn as opening, text and closing, of which only the text can bear loss."""
    text = escaped(turn["text"], template)
    opening, sep, closing = template.other
    out = F.array(
        _segment(F.concat(F.lit(opening), escaped(turn["role"], template), F.lit(sep)), False),
        _segment(text, False),
        _segment(F.lit(closing), False),
    )
    for name, role in template.roles.items():
        known = F.array(_segment(F.lit(role.opening), False), _segment(text, role.loss), _segment(F.lit(role.closing), False))
        out = F.when(turn["role"] == name, known).otherwise(out)
    return out


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: Template = INSTRUCT,
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, first_fault, segments, formatted.

    Turns are taken in order of (turn, role, text), nulls first, so ties have one defined order and
    repeated rows are repeated turns.  Null texts and roles count as empty.  The machine checks the order
    of roles: ``first_fault`` is the place (from 1) of the first turn that no move allows, or n_turns + 1 if the
    conversation ends in a state that is not final; null and ``valid`` if all is well.  Faulty
    conversations are formatted all the same.  ``segments`` are (text, loss) pairs whose texts make up
    ``formatted``.  A null conversation id is a conversation of its own.  The output has a row per
    conversation, so a conversation must fit into one row.
    """
    turns = rows.select(
        quoted(conv).alias("conv_id"),
        F.struct(
            quoted(turn).alias("turn"),
            F.coalesce(quoted(role), F.lit("")).alias("role"),
            F.coalesce(quoted(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, nexts in template.moves.items() for b in nexts])

    def step(state: Column, t: Column) -> Column:
        legal = F.array_contains(allowed, F.concat(state["at"], F.lit(">"), t["role"]))
        return F.struct(
            F.when(legal, t["role"]).otherwise(state["at"]).alias("at"),
            (state["place"] + 1).alias("place"),
            F.coalesce(state["fault"], F.when(~legal, state["place"] + 1)).alias("fault"),
        )

    begin = F.struct(F.lit(START).alias("at"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("long").alias("fault"))
    ran = chats.withColumn("ran", F.aggregate("turns", begin, step))
    ended = F.col("ran.at").isin(*template.final)
    out = ran.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.coalesce(F.col("ran.fault"), F.when(~ended, F.col("ran.place") + 1)).alias("first_fault"),
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
    )
    return out.select(
        "conv_id", "n_turns", F.col("first_fault").isNull().alias("valid"), "first_fault", "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
    )


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns, as an array of (role, text), that a formatted conversation was made of."""
    opening, sep, closing = template.other
    either = [(re.escape(r.opening), re.escape(r.closing)) for r in template.roles.values()]
    either.append((re.escape(opening), re.escape(closing)))
    parts = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(f"(?:{a}.*?{b})" for a, b in either)), F.lit(0))

    def turn(part: Column) -> Column:
        middle = F.locate(sep, part)
        head, tail = len(opening), len(sep)
        out = F.struct(
            unescaped(F.substring(part, F.lit(head + 1), middle - 1 - head), template).alias("role"),
            unescaped(F.substring(part, middle + tail, F.length(part) - middle + 1 - tail - len(closing)), template).alias("text"),
        )
        for name, role in template.roles.items():
            inner = F.substring(part, F.lit(len(role.opening) + 1), F.length(part) - len(role.opening) - len(role.closing))
            out = F.when(
                F.startswith(part, F.lit(role.opening)),
                F.struct(F.lit(name).alias("role"), unescaped(inner, template).alias("text")),
            ).otherwise(out)
        return out

    return F.transform(parts, turn)


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, as it was before escaping."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.concat_ws("", F.transform(kept, lambda s: unescaped(s["text"], template)))
