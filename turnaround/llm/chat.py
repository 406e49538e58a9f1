"""Chat formatting by prefix-target expansion: every assistant turn an example of its own.

DataFrame functions only. The template writes a turn as

    <turn ROLE>
    TEXT
    </turn>

with the role percent-encoded. Inside texts every `<turn` and `</turn` gets one more backslash before
the backslashes it may have, so a mark without one is always the template's, and reading takes one
off again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
END = "\n</turn>\n"
# Matches begin at the first backslash of a run, so long runs are read once.
_PLAIN = r"(?<!\\)(\\*</?turn)"
_ESCAPED = r"(?<!\\)\\(\\*</?turn)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def header(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n"))


def expand(turns: DataFrame) -> DataFrame:
    """`(conv_id, example, text, loss_start, loss_chars)`: one example per assistant turn.

    An example holds all preceding turns as context and ends with the assistant's turn; only that
    reply's text, `loss_chars` code points from `loss_start`, is trainable. What follows a
    conversation's last assistant turn becomes one more example, with nothing trainable, so that no
    turn is lost. `example` is the position of the example's last turn, from 1.

    Turns are ordered by `turn`, then role and text, so ties and repeated rows have a fixed order and
    all stay. A null text or role is an empty one, a null turn comes first, null conversation ids are
    one conversation. Empty texts are turns like any other; an empty table gives no example. Columns
    besides `conv_id`, `turn`, `role` and `text` are not read.

    Conversations are dealt by one shuffle; a conversation, as one training text, is a task's unit.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("*", header(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_reply = F.col("role") == ASSISTANT
    placed = rows.select(
        "conv_id", is_reply.alias("is_reply"), F.length("piece").alias("size"), F.length("head").alias("head_size"),
        F.length("body").alias("body_size"), F.row_number().over(order).cast("long").alias("example"),
        F.array_join(F.collect_list("piece").over(so_far), "").alias("text"),
        F.lead(F.lit(1)).over(order).isNull().alias("is_last"),
    )
    start = F.length("text") - F.col("size") + F.col("head_size")
    return placed.where("is_reply or is_last").select(
        "conv_id", "example", "text",
        F.when(F.col("is_reply"), start).cast("long").alias("loss_start"),
        F.when(F.col("is_reply"), F.col("body_size")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """An example's turns, read back: an array of (role, text)."""
    marked = F.split(text, END, -1)
    parts = F.slice(marked, 1, F.size(marked) - 1)

    def turn(part: Column) -> Column:
        head = F.regexp_extract(part, r"^<turn ([^>]*)>\n", 1)
        body = F.substr(part, F.length(head) + len("<turn >\n") + 1)
        return F.struct(F.url_decode(head).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: Column, start: Column, chars: Column) -> Column:
    """What the loss mask covers, as it was before escaping."""
    return F.when(chars > 0, unescape(F.substr(text, (start + 1).cast("int"), chars.cast("int")))).otherwise("")


def read_back(examples: DataFrame) -> DataFrame:
    """`(conv_id, n_examples, turns, loss, formatted_chars)` per conversation, from examples alone:
    all turns from the longest example, the loss text from each example's mask, in order."""
    masked = loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars"))
    grouped = examples.withColumn("masked", masked).groupBy("conv_id").agg(
        F.count("*").alias("n_examples"),
        F.max_by("text", "example").alias("longest"),
        F.sort_array(F.collect_list(F.struct("example", "masked"))).alias("parts"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    return grouped.select(
        "conv_id", "n_examples", read_turns(F.col("longest")).alias("turns"),
        F.array_join(F.col("parts.masked"), "").alias("loss"), "formatted_chars",
    )
