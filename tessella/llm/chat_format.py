"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply (without its
marks) is trainable. Turns after the last assistant turn, or all turns of a conversation that has none, become one more
example without a trainable span, so every turn can be read back from a conversation's last example.

A turn is written "### <role>: <text></turn>\\n". In roles and texts, backslash, '#', '<' and, in roles, ':' are written
\\b, \\h, \\l and \\c: neither '#' nor '<' is left inside a text, so no text can hold a control string, and the change is
undone by replacing the pairs.

Turns are gathered by conversation, the unit of the output, so a conversation has to fit in a task; many conversations
with the same content are no skew. The expansion writes every prefix again: its size is the square of the number of
turns, as the method has it.

Defined results: null text and null role count as empty; turns are ordered by turn (nulls first), then role, then text;
repeated rows stay repeated turns; a null conv_id is a conversation; an empty table gives no examples; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_ROLE = "assistant"
TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"


def escaped(c: Column, role: bool = False) -> Column:
    for raw, mark in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), *(((":", "\\c"),) if role else ())):
        c = F.replace(c, F.lit(raw), F.lit(mark))
    return c


def unescaped(c: Column) -> Column:
    for raw, mark in ((":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        c = F.replace(c, F.lit(mark), F.lit(raw))
    return c


def chat_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_length (code points; null: nothing trainable)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    r = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), r.alias("role"), t.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def written(x: Column) -> Column:
        head = F.concat(F.lit(TURN_START), escaped(x["role"], role=True), F.lit(ROLE_END))
        body = escaped(x["text"])
        return F.struct((x["role"] == TARGET_ROLE).alias("target"), F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(TURN_END)).alias("s"))

    convs = convs.select("conv_id", F.transform("ts", written).alias("w"))
    n = F.size("w")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("w", i)["target"] | (i == n))
    examples = convs.select("conv_id", "w", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("w", F.col("end"))
    before = F.array_join(F.transform(F.slice("w", F.lit(1), F.col("end") - 1), lambda x: x["s"]), "")
    made = examples.select("conv_id", "example", before.alias("before"), last.alias("last"))
    return made.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.concat("before", "last.s").alias("formatted"),
        F.when(F.col("last.target"), F.length("before") + F.col("last.head")).cast("long").alias("loss_start"),
        F.when(F.col("last.target"), F.col("last.body")).cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example as array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, TURN_END, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        at = F.instr(x, ROLE_END) if isinstance(x, str) else F.locate(ROLE_END, x)
        return F.struct(unescaped(F.substring(x, F.lit(len(TURN_START) + 1), at - 1 - len(TURN_START))).alias("role"), unescaped(F.substring(x, at + len(ROLE_END), F.length(x))).alias("text"))

    return F.transform(parts, turn)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples say when read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars by conversation."""
    loss = unescaped(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))
    # Only the last example's turns are read: it has them all.
    longest = F.max_by("formatted", "example")
    by = examples.groupBy("conv_id").agg(
        longest.alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("text"))))).alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    by = by.select("conv_id", read_turns(F.col("formatted")).alias("turns"), F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"), "formatted_chars")
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return by.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
