"""Chat formatting: collapse cumulative snapshots, then render, in DataFrame operations only.

Logs often hold a conversation several times, each snapshot a prefix of the
next. Two 64-bit digests of a conversation's first k turns are running
exclusive-ors of the digests of its turns, each with its place. A conversation
whose digests of all turns equal those of another one's first k goes: an
anti-join of whole conversations with longer ones' prefixes, by digest, leaves the
maximal conversations, which are rendered. Of equal conversations the one with the
least conv_id stays. Both sides of the anti-join hold each digest once, so a
conversation logged a million times costs one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns, dealt by conversation: one shuffle of texts serves all that groups by it."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return turns.repartition("conv_id").distinct()


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that no other one prolongs or equals with a smaller conv_id."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = _turns(conversations).select("conv_id", "role", "text", F.row_number().over(order).alias("place"), F.lead(F.lit(1)).over(order).isNull().alias("last"), "turn")
    running = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = placed.select(
        "conv_id", "last", F.col("place").alias("n_turns"),
        F.bit_xor(F.xxhash64(F.lit(1), "place", "role", "text")).over(running).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), "text", "place", "role")).over(running).alias("h2"),
    )
    key = ["n_turns", "h1", "h2"]
    whole = prefixes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    prolonged = prefixes.where("not last").select(*key).distinct()
    return whole.join(prolonged, key, "left_anti").select("conv_id", "n_turns", "n_equal")


def render(conversations: DataFrame, open_mark: str = OPEN, close_mark: str = CLOSE) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_equal (copies it stands for, itself included), n_chars, rendered.

    Turns follow their number, then role and text. A row that repeats another is
    one turn; null roles and texts count as empty; a null turn comes first; rows
    without conv_id are left out. An empty table gives no rows. Other columns are
    not read.
    """
    turns = _turns(conversations)
    kept = maximal(conversations)
    line = F.concat(F.lit(open_mark), F.col("role"), F.lit("\n"), F.col("text"), F.lit(close_mark + "\n"))
    rendered = (
        turns.join(kept.select("conv_id"), "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda x: x["line"]), "").alias("rendered"))
    )
    return kept.join(rendered, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_equal", F.length("rendered").cast("long").alias("n_chars"), "rendered")
