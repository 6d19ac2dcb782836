"""Chat formatting with cumulative snapshots collapsed, by DataFrame operations only.

A service that logs a conversation after every turn leaves snapshots, each a prefix of the next.  Every turn gets two
60-bit hashes of its position, role and text; their running XOR over a conversation is the hash of the prefix that ends
there (two lanes, 120 bits).  A conversation whose whole hash is another's proper prefix is dropped by a left anti
join; of equal conversations the least conv_id stays, counted in ``n_copies``.  What is left is maximal and is
rendered.

Scale: proper prefixes are made distinct and copies are merged by aggregates that combine before the shuffle, so a
snapshot or first turn shared by a third of all conversations is one row a task in the joins.  The running window holds
two numbers; texts are gathered by conversation only to render it.

Defined results: turns are ordered by (turn, role, text), nulls first, and repeated rows count as turns; one conversation of
any length is ordered by one task, and rendered by one; rows with a
null conv_id form one conversation; a null role is rendered as ``unknown`` and differs from every role, a null text is
rendered empty and differs from the empty text; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _marked(c: str) -> Column:
    """A text that tells null, lengths and contents apart."""
    return F.concat(F.coalesce(F.char_length(c), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.col(c), F.lit("")))


def _lane(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, a, b): the hash of the first k of the conversation's n turns."""
    rows = turns.select("conv_id", F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    body = F.sha2(F.concat(_marked("role"), _marked("text")), 256)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("body", body).select("conv_id", "body", F.row_number().over(order).alias("k"))
    digest = placed.select("conv_id", "k", F.sha2(F.concat_ws("|", F.col("k").cast("string"), "body"), 256).alias("digest"))
    along = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    return digest.select(
        "conv_id",
        "k",
        F.count("*").over(whole).alias("n"),
        F.bit_xor(_lane(F.col("digest"), 1)).over(along).alias("a"),
        F.bit_xor(_lane(F.col("digest"), 17)).over(along).alias("b"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one extends."""
    rows = prefixes(turns)
    proper = rows.where("k < n").select("k", "a", "b").distinct()
    whole = rows.where("k = n").groupBy(F.col("n").alias("k"), "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return whole.join(proper, ["k", "a", "b"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat) of every maximal conversation."""
    kept = maximal(turns).select(F.col("conv_id").alias("__kept"), "n_turns", "n_copies")
    rows = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    said = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("__kept")))
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    turn = F.struct("turn", "role", "text", line.alias("line"))
    grouped = said.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.col("turns.line")).alias("chat"))
