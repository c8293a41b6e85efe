"""Chat formatting: turn spans found by rendering successive prefixes of a conversation through any template."""

from __future__ import annotations

import functools
import itertools
import os.path
import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrid.llm.common import whole

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Fixed control strings of the default template.
START, END = "<|im_start|>", "<|im_end|>"

TURNS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>"
_TURN = pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_())])
_OPENED = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No control string is left: between ``<`` and ``|`` stands one backslash more than before."""
    return _OPENED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As a text, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def marked_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def marked(turns: Turns) -> str:
    """Default template: every turn between control strings, texts escaped."""
    return "".join([marked_turn(role, text) for role, text in turns])


def marked_once() -> Template:
    """The default template for the prefixes of one conversation: a turn is escaped once, however many prefixes it is in."""
    piece = functools.cache(marked_turn)
    return lambda turns: "".join(itertools.starmap(piece, turns))


def read_marked(formatted: str) -> Turns:
    """The turns of a text that the default template rendered."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: rest.rindex(END)])))
    return turns


def locate(turns: Turns, template: Template) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """Render every prefix; a turn's span is what its prefix adds to the one before.

    Two probes in place of a turn's text tell the frame around it: their common beginning and common end. A prefix
    that is not continued by the next one was rewritten: then the spans are None.
    """
    if template is marked:
        template = marked_once()
    spans, last = [], template([])
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(last):
            return template(turns), None
        probes = [template([*turns[:k], (role, probe)]) for probe in "AB"]
        if not all(p.startswith(last) for p in probes):
            return template(turns), None
        added = [p[len(last) :] for p in probes]
        head = len(os.path.commonprefix(added))
        tail = len(os.path.commonprefix([p[::-1] for p in added]))
        spans.append((len(last), len(now), len(last) + head, len(now) - tail))
        last = now
    return last, spans


def structs(lists: pa.Array, *fields: str) -> list[list[tuple]]:
    """Lists of structs as tuples of some fields, converted column by column and not struct by struct."""
    flat = lists.flatten()
    rows = zip(*[flat.field(f).to_pylist() for f in fields], strict=True)
    return [list(itertools.islice(rows, n)) for n in pc.list_value_length(lists).to_pylist()]


def format_chats(turns: DataFrame, template: Template = marked, learn: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, ``formatted``, ``turns`` (spans in code points, ends open) and ``rewrites``.

    ``text_start`` and ``text_end`` bound the rendered text of a turn; ``loss`` marks turns of the roles to ``learn``.
    ``rewrites`` is true where the template changes earlier turns when later ones come; then ``turns`` is empty and no
    text is under the loss. Rows of a conversation go by turn, null first, then role and text, so ties and repeated
    rows have one order; null roles and texts are empty; rows with a null id are one conversation. Other columns are
    not read. One conversation is one output row, so it must fit in one; prefix rendering takes time in the square of
    its turns.
    """
    rows = turns.select(F.col(conv_col).alias("_conv"), F.struct(F.col(turn_col).alias("turn"), whole(F.col(role_col)).alias("role"), whole(F.col(text_col)).alias("text")).alias("_row"))

    @F.arrow_udf(f"struct<formatted:string,turns:{TURNS},rewrites:boolean>")
    def render(lists: pa.Array) -> pa.Array:
        out = []
        for said in structs(lists, "role", "text"):
            formatted, spans = locate(said, template)
            out.append((formatted, [(role, *span, role in learn) for (role, _), span in zip(said, spans or [], strict=spans is not None)], spans is None))
        return pa.array(out, pa.struct([("formatted", pa.string()), ("turns", pa.list_(_TURN)), ("rewrites", pa.bool_())]))

    chats = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    return chats.select("_conv", render("_rows").alias("_out")).select(F.col("_conv").alias(conv_col), "_out.formatted", "_out.turns", "_out.rewrites")


@F.arrow_udf(T.ArrayType(T.StructType().add("role", "string").add("text", "string")))
def read_turns(formatted: pa.Array) -> pa.Array:
    """Roles and texts read back from what the default template rendered."""
    kind = pa.struct([("role", pa.string()), ("text", pa.string())])
    return pa.array([read_marked(x) for x in formatted.to_pylist()], pa.list_(kind))


@F.arrow_udf(T.StringType())
def loss_text(formatted: pa.Array, turns: pa.Array) -> pa.Array:
    """All text under the loss, unescaped, in order."""
    spans = structs(turns, "text_start", "text_end", "loss")
    return pa.array(["".join([unescape(x[start:end]) for start, end, loss in own if loss]) for x, own in zip(formatted.to_pylist(), spans, strict=True)], pa.string())
