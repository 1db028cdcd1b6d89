"""Chat formatting: conversations to one text each, with loss flags for each segment.

A declarative template names the control strings, the roles whose text is learnt from and the allowed
transitions between roles. Everything is expressed with Spark's own functions: turns are gathered by
conversation, a fold over them runs the finite-state machine, and each turn's segments are emitted with the state that
the machine reached by it: the state says whether its text is learnt from.

Inside roles and texts a backslash becomes ``\\s`` and ``<|`` becomes ``<\\p|``; line feeds in roles
become ``\\n``. No control string, all of which begin with ``<|``, can then stand in a text, and the
escapes are undone exactly when the output is read back.

Defined cases: null text or role counts as empty; rows of one conversation are ordered by turn (null
first), then role, then text, so ties and repeated rows give the same output each time; a null conv_id is
a conversation of its own; an order that the machine rejects is formatted too, with valid = false and
the number of the first rejected turn; no rows give no rows. Other columns are not read. The rows of
one conversation are one text in the end, and so meet in one task: a conversation must fit there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    #: states whose turns are learnt from
    loss_states: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> roles that may come next; the role is the next state
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    accepting: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p|"))


def unescape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p|"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape_text(F.replace(role, F.lit("\\n"), F.lit("\n")))


def machine(turns: Column, template: ChatTemplate) -> Column:
    """Fold of the role automaton: the state after each turn, and the first rejected turn (or null). After a turn that it
    rejects, the machine goes on from the state of the turn's role."""
    allowed = F.create_map(*[F.lit(x) for state, roles in template.transitions.items() for role in roles for x in (f"{state}\n{role}", role)])

    def step(acc: Column, turn: Column) -> Column:
        reached = F.try_element_at(allowed, F.concat_ws("\n", acc["state"], turn["role"]))
        fails = acc["error_turn"].isNull() & reached.isNull()
        state = F.coalesce(reached, turn["role"])
        return F.struct(
            state.alias("state"),
            F.concat(acc["states"], F.array(state)).alias("states"),
            F.when(fails, F.size(acc["states"])).otherwise(acc["error_turn"]).alias("error_turn"),
        )

    none = F.array().cast("array<string>")
    first = F.struct(F.lit(template.start).alias("state"), none.alias("states"), F.lit(None).cast("int").alias("error_turn"))
    return F.aggregate(turns, first, step)


def format_chats(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """conv_id, n_turns, formatted, segments array<struct<text, loss>>, valid, error_turn."""
    t = template or ChatTemplate()
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def turn_segments(turn: Column, state: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(t.turn_start), escape_role(turn["role"]), F.lit(t.role_end)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), state.isin(*t.loss_states).alias("loss")),
            F.struct(F.lit(t.turn_end).alias("text"), F.lit(False).alias("loss")),
        )

    staged = grouped.withColumn("machine", machine(F.col("turns"), t))
    staged = staged.withColumn("segments", F.flatten(F.zip_with("turns", "machine.states", turn_segments)))
    return staged.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        (F.col("machine.error_turn").isNull() & F.col("machine.state").isin(*t.accepting)).alias("valid"),
        F.col("machine.error_turn").alias("error_turn"),
    )


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns read back from a formatted text: array<struct<role, text>>, unescaped."""
    t = template or ChatTemplate()
    literal = lambda s: "\\Q" + s + "\\E"
    parts = F.slice(F.split(formatted, literal(t.turn_start)), F.lit(2), F.greatest(F.lit(0), F.size(F.split(formatted, literal(t.turn_start))) - 1))

    def parse(part: Column) -> Column:
        role = F.substring_index(part, t.role_end, 1)
        body = F.substr(part, F.char_length(role) + F.lit(1 + len(t.role_end)), F.char_length(part) - F.char_length(role) - F.lit(len(t.role_end) + len(t.turn_end)))
        return F.struct(unescape_role(role).alias("role"), unescape_text(body).alias("text"))

    return F.transform(parts, parse)
