"""Conversations as training text: a finite-state machine over roles checks the order of
turns, and a declarative template says what each role's turn emits and which parts of
it are learned (the loss mask).

All steps are DataFrame expressions. A conversation becomes one row, because its text
is one string; turns are put in order inside that row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """before, body and after of a turn, and the roles whose body is learned; the states
    of the machine: (state, role) -> state. What has no transition is an error, after
    which the machine goes on as if the role had been due."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escape(text: Column) -> Column:
    """No '<|' is left: each '<', backslashes, '|' gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line and holds no '<'."""
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row for each conv_id of turns(conv_id, turn, role, text):

    conv_id; n_turns; segments, an array of (text, loss) in order; formatted, the
    segments joined; valid, whether the machine accepts the order of roles and ends in a
    final state; first_error, the place (from 0) of the first turn out of order, else
    null. Turns stand by `turn` (null first), then role and text. Null role or text
    counts as empty, a null conv_id is a conversation like any other, repeated rows are
    turns of their own; other columns are not read; very long texts are kept whole: a
    conversation is one row, and one string of at most two gigabytes; an empty table gives no
    rows."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\x00{role}", to)])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error"))

    def move(a: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(a["state"], F.lit("\x00"), t["role"]))
        error = F.coalesce(a["error"], F.when(to.isNull(), a["at"]))
        return F.struct(F.coalesce(to, t["role"]).alias("state"), (a["at"] + 1).alias("at"), error.alias("error"))

    def emitted(t: Column) -> Column:
        parts = (
            (F.concat(F.lit(template.open), escape_role(t["role"]), F.lit("\n")), F.lit(False)),
            (escape(t["text"]), t["role"].isin(*template.learned)),
            (F.lit(f"{template.close}\n"), F.lit(False)),
        )
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    ended = F.aggregate("turns", begin, move)
    out = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), ended.alias("end"), F.flatten(F.transform("turns", emitted)).alias("segments"))
    valid = F.col("end.error").isNull() & F.col("end.state").isin(*template.final)
    return out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), valid.alias("valid"), F.col("end.error").alias("first_error"))


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns, (role, text), that a formatted conversation holds."""
    parts = F.split(formatted, f"\\Q{template.close}\\E\n")
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(s: Column) -> Column:
        head = F.substring_index(s, "\n", 1)
        role = unescape_role(F.substring(head, len(template.open) + 1, 1 << 30))
        return F.struct(role.alias("role"), unescape(F.substr(s, F.char_length(head) + 2)).alias("text"))

    return F.transform(turns, turn)


def learned_text(segments: Column) -> Column:
    """What the loss mask covers, in order, escapes undone."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
