"""Collapse of cumulative conversation logs, then rendering.

A chat that is logged again after every turn leaves snapshots, each the beginning of the next. Rolling hashes of turn
prefixes find them: a conversation goes when its hash over all turns is that of a shorter prefix of another one, or when
another one with a smaller id has the same turns. What stays is maximal and is rendered to one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Marks of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ROLES = ("system", "user", "assistant", "tool")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with their place in the conversation (``k`` from 1) and two 64-bit hashes of all turns up to it.

    Each turn's hash covers its place, role and text; the rolling hash combines them bit by bit, so order counts.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("k", F.row_number().over(order))
    present = F.struct(F.col("role").isNull(), F.col("text").isNull())
    one = placed.withColumn("h1", F.xxhash64(F.lit(11), "k", "role", "text", present)).withColumn("h2", F.xxhash64(F.lit(23), "text", F.lit("\0"), "role", "k", present))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return one.withColumn("h1", F.bit_xor("h1").over(upto)).withColumn("h2", F.bit_xor("h2").over(upto))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of the conversations that neither begin a longer one nor repeat one with a smaller id."""
    hashed = prefix_hashes(_clean(turns)).select("conv_id", "k", "h1", "h2")
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("k", "h1", "h2")).alias("e")).select("conv_id", F.col("e.k").alias("k"), F.col("e.h1").alias("h1"), F.col("e.h2").alias("h2"))
    firsts = ends.groupBy("h1", "h2", "k").agg(F.min("conv_id").alias("conv_id"))  # of equal conversations the smallest id
    # Prefixes of the conversations left that end before the conversation does; each hash once, however many share it.
    inner = hashed.join(firsts.select("conv_id", F.col("k").alias("n")), "conv_id").where("k < n").select("h1", "h2", "k").distinct()
    return firsts.join(inner, ["h1", "h2", "k"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"))


def _clean(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", "role", "text").where("conv_id is not null").distinct()


def render(turns: DataFrame) -> DataFrame:
    """``(conv_id, rendered)``: the turns of each conversation in order, between marks.

    Marks inside texts and roles are broken up with a space so that they cannot pass for turns.
    """
    plain = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    role = F.lower(F.trim(plain(F.col("role"))))
    shown = F.concat(F.lit(OPEN), F.when(role == "", "user").otherwise(role), F.lit("\n"), plain(F.col("text")), F.lit(CLOSE + "\n"))
    one = turns.select("conv_id", F.struct("turn", "role", "text", shown.alias("shown")).alias("t"))
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.array_join(F.col("t.shown"), "").alias("rendered"))


def chat_format(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, rendered)`` of each maximal conversation of ``turns`` (conv_id, turn, role, text).

    Turns are ordered by (turn, role, text), nulls first; repeated rows count once; rows without a conv_id are left out;
    a null text renders as empty, a null or blank role as ``user``. Other columns are ignored. An empty table gives no rows.
    """
    kept = maximal_conversations(turns)
    rows = _clean(turns).join(kept, "conv_id", "left_semi")
    return render(rows).join(kept, "conv_id").select("conv_id", "n_turns", "rendered")
