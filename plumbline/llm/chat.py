"""Chat formatting: a role automaton and a declarative template turn conversations into training text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a turn looks like, which roles are learned, and which turn orders are valid.

    A turn is written as ``head + shown role + after_role + text + end``. ``head``,
    ``after_role`` and ``end`` are control strings; inside roles and texts each control
    string becomes its escape, and a backslash doubles, so the text can be cut and
    unescaped again without loss. ``moves`` maps a state and a role to the next state;
    a pair that is missing leads to the rejecting state.
    """

    head: str = "### "
    after_role: str = ": "
    end: str = " </turn>\n"
    marks: tuple[tuple[str, str], ...] = (("###", "\\h"), ("</turn>", "\\e"))
    shown: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: tuple[tuple[str, str, str], ...] = field(
        default=(
            ("start", "system", "briefed"),
            ("start", "user", "asked"),
            ("briefed", "user", "asked"),
            ("asked", "assistant", "answered"),
            ("answered", "user", "asked"),
        )
    )


REJECTED = "rejected"


def escape(text: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    """Double backslashes, then put the escapes in place of the control strings."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark, code in marks:
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescape(text: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    """Undo escape(): between doubled backslashes every backslash starts an escape."""

    def plain(piece: Column) -> Column:
        for mark, code in marks:
            piece = F.replace(piece, F.lit(code), F.lit(mark))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def _role_marks(t: Template) -> tuple[tuple[str, str], ...]:
    return (*t.marks, (t.after_role, "\\c"))


def _shown(role: Column, t: Template) -> Column:
    """Known roles by their shown name; others as ~ and the escaped role, which no shown name starts with."""
    out = F.concat(F.lit("~"), escape(role, _role_marks(t)))
    for name, show in t.shown:
        out = F.when(role == name, F.lit(show)).otherwise(out)
    return out


def _read_role(shown: Column, t: Template) -> Column:
    out = unescape(F.substring(shown, 2, 2**31 - 1), _role_marks(t))
    for name, show in t.shown:
        out = F.when(shown == show, F.lit(name)).otherwise(out)
    return out


def _walk(roles: Column, t: Template) -> Column:
    """The automaton's state after all roles."""
    step = F.create_map(*[F.lit(x) for a, r, b in t.moves for x in (f"{a}\n{r}", b)])
    return F.aggregate(roles, F.lit(t.start), lambda s, r: F.coalesce(F.try_element_at(step, F.concat_ws("\n", s, r)), F.lit(REJECTED)))


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, text).

    Returns conv_id, n_turns, ``segments`` (array of text and loss: whether the segment is
    learned), ``formatted`` (all segment texts joined) and ``valid`` (the automaton accepts
    the order of roles). Invalid conversations are formatted too; drop them by ``valid``.

    Turns are taken by turn number, nulls first; equal numbers by role, then text, and
    repeated rows stay. A null role or text counts as empty; an empty role is unknown to the
    automaton. Rows with a null conv_id form one conversation. Other columns are ignored, an
    empty table gives no rows. A conversation is one output value, so one task must hold it.
    """
    t = template
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segment(piece: Column, loss: Column) -> Column:
        return F.struct(piece.alias("text"), loss.alias("loss"))

    off = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(F.concat(F.lit(t.head), _shown(x.role, t), F.lit(t.after_role)), off),
                segment(escape(x.text, t.marks), x.role.isin(*t.learned)),
                segment(F.lit(t.end), off),
            ),
        )
    )
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        segments.alias("segments"),
        _walk(F.transform("turns", lambda x: x.role), t).isin(*t.final).alias("valid"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """Array of role and text, cut from formatted text alone."""
    t = template
    # Escaped texts hold no control string, so the end mark with its line break only stands between turns.
    pieces = F.split(formatted, "(?<=" + _literal(t.end) + ")")
    turns = F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: p.substr(F.lit(len(t.head) + 1), F.length(p) - F.lit(len(t.head) + len(t.end))),
    )

    def cut(p: Column) -> Column:
        at = F.position(F.lit(t.after_role), p)
        return F.struct(
            _read_role(F.substring(p, F.lit(1), at - 1), t).alias("role"),
            unescape(F.substring(p, at + len(t.after_role), F.length(p)), t.marks).alias("text"),
        )

    return F.transform(turns, cut)


def read_learned(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text, template.marks)), "")


def _literal(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)
