"""Chat formatting: a declarative template, a state machine over roles, loss flags per segment.

Every turn becomes three text segments: its opening mark with the role, its text, its closing mark. Control
strings begin with `<|`; inside a text a backslash is put between the two characters, before those that stand
there already, so that no text holds a control string and the change can be undone. Turns are formatted row by
row before the conversation's rows meet. Only DataFrame functions are used.

Defined results: a null text or role is empty; turns are ordered by turn (null first), then role, then text, so
ties and repeated rows have one order and all stay; rows with a null conversation id form one conversation;
other columns are not read. A role that the template does not know makes the conversation invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "open": "<|im_start|>",
    "after_role": "\n",
    "close": "<|im_end|>\n",
    "loss_roles": ["assistant"],
    "turns": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "final": ["assistant"],
}


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    """A role on one line without control strings."""
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _state(turns: Column, template: dict) -> Column:
    """State of the machine after all turns: the last role, or `invalid`."""
    moves = [F.lit(x) for state, roles in template["turns"].items() for role in roles for x in (f"{state}>{role}", role)]
    table = F.create_map(*moves)
    return F.aggregate(turns, F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(table, F.concat(s, F.lit(">"), t["role"])), F.lit("invalid")))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation: id, `formatted`, `segments` (text, loss) whose texts joined are `formatted`, `valid`."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    one = rows.select(F.col(conv).alias(conv), F.struct(F.col(turn).alias("turn"), role_.alias("role"), escaped(text_).alias("text")).alias("t"))
    turns = one.groupBy(conv).agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        def part(value: Column, loss) -> Column:
            return F.struct(value.alias("text"), loss.alias("loss"))

        return F.array(
            part(F.concat(F.lit(template["open"]), _role_out(t["role"]), F.lit(template["after_role"])), F.lit(False)),
            part(t["text"], t["role"].isin(template["loss_roles"])),
            part(F.lit(template["close"]), F.lit(False)),
        )

    done = turns.select(conv, F.flatten(F.transform("turns", segments)).alias("segments"), _state(F.col("turns"), template).isin(template["final"]).alias("valid"))
    return done.select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """Role and text of every turn, read back from the formatted string."""
    parts = F.split(formatted, "\\Q" + template["close"] + "\\E")
    skip = len(template["open"]) + 1

    def turn(p: Column) -> Column:
        line = F.substring_index(F.substr(p, F.lit(skip)), template["after_role"], 1)
        return F.struct(_role_in(line).alias("role"), unescaped(F.substr(p, F.length(line) + skip + len(template["after_role"]))).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
