"""Relational chat formatting in Spark expressions only.

Turns of a conversation are collected as structs and sorted by turn (then role and text; nulls first), adjacent turns of
one role are merged into one block with array functions, and the blocks are concatenated:

    <|turn|>role<|text|>first text<|next|>second text<|end|>

`<|next|>` keeps the merged texts apart, so that reading back gives the very turns. Inside roles and texts a `~` is put
after each `<` that stands before `|` or `~`; no text then contains `<|`, and unescape takes the `~` out again.

The output has `segments`, array<struct<text, loss>>: their concatenation is the formatted string, and loss is true for
the texts of the trained role alone, one segment each. A null role or text counts as empty; repeated rows are repeated
turns; a null conv_id is a conversation of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, "<([|~])", "<~$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, "<~([|~])", "<$1")


def _split(c: Column, marker: str) -> Column:
    return F.split(c, rf"\Q{marker}\E", -1)


def format_conversations(turns: DataFrame, *, trained_role: str = "assistant") -> DataFrame:
    """A row per conversation: conv_id, formatted, segments."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    # Where a role begins that isn't the one before, a block begins.
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    blocked = sorted_turns.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(n + 1))
    blocks = F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda s: F.slice("turns", s["a"], s["b"] - s["a"]))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    plain = lambda text: piece(text, F.lit(False))

    def block(b: Column) -> Column:
        role = b[0]["role"]
        head = plain(F.concat(F.lit(TURN), escape(role), F.lit(TEXT)))
        texts = F.flatten(F.transform(b, lambda t, i: F.when(i > 0, F.array(plain(F.lit(NEXT)), piece(escape(t["text"]), role == trained_role))).otherwise(F.array(piece(escape(t["text"]), role == trained_role)))))
        return F.concat(F.array(head), texts, F.array(plain(F.lit(END))))

    out = blocked.select("conv_id", F.flatten(F.transform(blocks, block)).alias("segments"))
    return out.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the very turns that a formatted string was made from."""
    parts = _split(formatted, TURN)
    blocks = F.slice(parts, F.lit(2), F.size(parts))

    def turns(block: Column) -> Column:
        halves = _split(F.substring_index(block, END, 1), TEXT)
        return F.transform(_split(halves[1], NEXT), lambda text: F.struct(unescape(halves[0]).alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def turn_digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as digests."""
    read = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")
