"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, and
only that reply trainable. Turns are marked ``<|im_start|>role\\n`` ...
``<|im_end|>\\n``; inside roles and texts a backslash is doubled and ``<|`` is
written ``<\\|``, so no text can forge a mark and unescaping gives it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """A role also ends at the first newline, so its own newlines become backslash and newline."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def marked(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def transcripts(turns: DataFrame) -> DataFrame:
    """One row per conversation: the marked-up transcript and the spans of its examples.

    Rows go by turn, then role and text (ties and repeated rows stay), a null
    turn first; null role or text counts as empty. Spans are character offsets:
    an example is the transcript up to ``stop``, its reply text lies in
    [loss_start, loss_stop). Turns after the last reply belong to no reply's
    context; they come as one more example without a loss span, so nothing of
    the conversation is missing from the output.

    A conversation is one row because its examples hold it as one text.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chars = F.length(marked(F.col("role"), F.col("text"))).cast("long")
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("stop", F.sum(chars).over(so_far))
    per = ends.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "stop"))).alias("turns"))
    closing = len(END) + 1

    def reply_span(t: Column) -> Column:
        loss_stop = t["stop"] - closing
        return F.struct(t["stop"].alias("stop"), (loss_stop - F.length(escape(t["text"]))).alias("loss_start"), loss_stop.alias("loss_stop"))

    replies = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), reply_span)
    last = F.element_at(F.col("turns"), -1)
    tail = F.array(F.struct(last["stop"].alias("stop"), F.lit(None).cast("long").alias("loss_start"),
                            F.lit(None).cast("long").alias("loss_stop")))
    return per.select("conv_id", F.array_join(F.transform("turns", lambda t: marked(t["role"], t["text"])), "").alias("transcript"),
                      F.when(last["role"] == "assistant", replies).otherwise(F.concat(replies, tail)).alias("spans"))


def prefix_examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example (from 0), last, text, loss_start, loss_stop (null: no loss).

    ``turns`` has conv_id, turn, role, text; other columns are ignored. The
    example's text ends with its reply; [loss_start, loss_stop) is all of it
    that trains. ``last`` marks the longest example of the conversation.
    """
    spans = transcripts(turns).select("conv_id", "transcript", F.size("spans").alias("n"), F.posexplode("spans").alias("example", "s"))
    return spans.select("conv_id", "example", (F.col("example") == F.col("n") - 1).alias("last"),
                        F.substring(F.col("transcript"), F.lit(1), F.col("s.stop").cast("int")).alias("text"),
                        F.col("s.loss_start").alias("loss_start"), F.col("s.loss_stop").alias("loss_stop"))


def parse_turns(text: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    pieces = F.split(text, r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def turn(p: Column) -> Column:
        head = F.regexp_extract(p, r"(?s)\A((?:\\.|[^\\\n])*)\n", 1)
        body = F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - len(END) - 2)
        return F.struct(unescape(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the examples alone.

    The turns come from each conversation's last example, the loss text from
    the masked span of every example, in order.
    """
    span = F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int"))
    turns = F.when(F.col("last"), parse_turns(F.col("text")))
    joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = examples.select("conv_id", "example", F.length("text").cast("long").alias("chars"), F.coalesce(unescape(span), F.lit("")).alias("loss"),
                           F.size(turns).cast("long").alias("n"), F.sha2(joined, 256).alias("sha"), "last")
    per = rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("n"))).alias("n_turns"), F.max(F.when(F.col("last"), F.col("sha"))).alias("turns_sha256"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("replies"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.col("replies.loss"), "")
    return per.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"),
                      F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
