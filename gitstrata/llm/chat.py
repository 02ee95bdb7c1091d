"""Chat formatting: a finite-state machine over roles and a declarative template.

The template says for each role which control strings open and close a turn and whether the turn's text
is trained on. Control strings are the only places where ``<`` and ``[`` occur in the output: inside
texts (and names of roles the template doesn't know) they are escaped with a backslash code, and
``read_back`` undoes that. The machine starts in "start"; a turn whose role has no transition from the
state it meets makes the conversation invalid, which is reported, not dropped.

A conversation's rows are ordered by turn (null last), then role and text, so repeated rows have a
place too. They are first gathered in chunks of ``chunk`` turn numbers and then the chunks in order, so
that formatting a long conversation is spread over tasks. A null text is empty, a null role is an
unknown role with an empty name, rows with a null conv_id form one conversation; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: Mapping[str, Role] = field(default_factory=lambda: {
        "system": Role("[SYS] ", " [/SYS]\n"),
        "user": Role("[INST] ", " [/INST]\n"),
        "assistant": Role("<s>", "</s>\n", loss=True),
    })
    other_opens: str = "[ROLE {}] "
    other_closes: str = " [/ROLE]\n"
    #: state -> role -> next state; a state is the last role.
    moves: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    ends: tuple[str, ...] = ("assistant",)


#: What stands for a character inside texts. Every backslash of escaped text is followed by a code.
ESCAPES = (("\\", "\\0"), ("[", "\\1"), ("<", "\\2"), ("]", "\\3"))


def escaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, F.coalesce(text, F.lit("")))


def unescaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), ESCAPES[::-1], text)


def _by_role(role: Column, known: Mapping[str, Column], other: Column) -> Column:
    return reduce(lambda out, kv: F.when(role == kv[0], kv[1]).otherwise(out), known.items(), other)


def segments(role: Column, text: Column, template: Template) -> Column:
    """array<struct<text, loss>>: a turn's opening, text and closing, each with its flag."""
    name = F.concat(F.lit(template.other_opens.split("{}")[0]), escaped(role), F.lit(template.other_opens.split("{}")[1]))
    opens = _by_role(role, {k: F.lit(r.opens) for k, r in template.roles.items()}, name)
    closes = _by_role(role, {k: F.lit(r.closes) for k, r in template.roles.items()}, F.lit(template.other_closes))
    loss = _by_role(role, {k: F.lit(r.loss) for k, r in template.roles.items()}, F.lit(False))
    part = lambda t, on: F.struct(t.alias("text"), on.alias("loss"))
    return F.array(part(opens, F.lit(False)), part(escaped(text), loss), part(closes, F.lit(False)))


def _moves(before: Column, role: Column, template: Template) -> Column:
    """Whether the machine may read ``role`` in state ``before``."""
    pairs = [F.lit(f"{state}>{r}") for state, rs in template.moves.items() for r in rs]
    return F.array_contains(F.array(*pairs), F.concat(before, F.lit(">"), role))


def format_chat(conversations: DataFrame, template: Template | None = None, chunk: int = 64) -> DataFrame:
    """conv_id, n_turns (long), valid (boolean), segments array<struct<text, loss>>, formatted (string)."""
    template = template or Template()
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / chunk).alias("_chunk"),
        F.struct(F.col("turn").isNull().alias("n"), F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_row"),
    )
    chunks = rows.groupBy("conv_id", "_chunk").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    chunks = chunks.select(
        "conv_id",
        F.struct(
            F.col("_chunk").isNull().alias("n"), F.col("_chunk").alias("c"),
            F.transform("_rows", lambda r: r.role).alias("roles"),
            F.flatten(F.transform("_rows", lambda r: segments(r.role, r.text, template))).alias("segments"),
        ).alias("_part"),
    )
    parts = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("_part"))).alias("_parts"))
    roles = F.flatten(F.transform("_parts", lambda p: p.roles))
    pairs = F.transform(F.zip_with(F.concat(F.array(F.lit("start")), roles), roles, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p)
    ok = F.forall(F.filter(pairs, lambda p: p.b.isNotNull()), lambda p: _moves(p.a, p.b, template))
    out = parts.withColumn("_roles", roles).withColumn("segments", F.flatten(F.transform("_parts", lambda p: p.segments)))
    return out.select(
        "conv_id", F.size("_roles").cast("long").alias("n_turns"),
        (ok & F.element_at("_roles", -1).isin(*template.ends)).alias("valid"),
        "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
    )


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}<>/" else c for c in text)


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> of a formatted conversation: the turns, unescaped."""
    template = template or Template()
    before, after = map(_quoted, template.other_opens.split("{}"))
    opens = [_quoted(r.opens) for r in template.roles.values()] + [before + r"[^\[<\]]*" + after]
    closes = [_quoted(r.closes) for r in template.roles.values()] + [_quoted(template.other_closes)]
    turn = f"(?s)({'|'.join(opens)})([^\\[<]*)({'|'.join(closes)})"
    known = {r.opens: F.lit(name) for name, r in template.roles.items()}

    def role(o: Column) -> Column:
        first, last = map(len, template.other_opens.split("{}"))
        return _by_role(o, known, unescaped(F.substring(o, F.lit(first + 1), F.char_length(o) - first - last)))

    return F.zip_with(
        F.regexp_extract_all(formatted, F.lit(turn), F.lit(1)), F.regexp_extract_all(formatted, F.lit(turn), F.lit(2)),
        lambda o, t: F.struct(role(o).alias("role"), unescaped(t).alias("text")),
    )
