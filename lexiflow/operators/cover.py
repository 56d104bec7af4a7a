"""Texts that cover all units (F17): the greedy cover, many texts a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, shared_table
from .splits import seeded


def greedy_cover(texts: DataFrame, name: str, units: str, seed: str = "") -> DataFrame:
    """Texts (name, gain) that the greedy cover takes: always the one with most units not covered yet, ties by a seeded hash, then by name.

    A text is taken as soon as it is the best one for every uncovered unit that it holds: nothing that shares a unit with it
    can come before it, and nothing changes its gain meanwhile, so the result is that of taking one at a time. Frequent
    units are aggregates with map-side combine. Texts without units aren't taken; rows of one name are one text.
    """
    left = shared_table(texts.select(name, F.explode(units).alias("unit")).where(F.col("unit").isNotNull() & F.col(name).isNotNull()).distinct())
    taken = None
    while not left.isEmpty():
        gain = left.groupBy(name).agg(F.count("*").alias("gain"))
        ranked = left.join(gain, name).withColumn("_rank", F.struct(-F.col("gain"), seeded(name, seed), F.col(name)))
        best = ranked.groupBy("unit").agg(F.min_by(F.struct(F.col(name), F.col("gain")), "_rank").alias("b"))
        won = best.groupBy(F.col(f"b.{name}").alias(name), F.col("b.gain").alias("gain")).agg(F.count("*").alias("_n")).where(F.col("_n") == F.col("gain")).drop("_n")
        held = shared_table(won)
        covered = left.join(held.select(name), name, "left_semi").select("unit").distinct()
        old, left = left, shared_table(left.join(covered, "unit", "left_anti"))
        discard(old)
        taken = held if taken is None else taken.unionByName(held)
    return taken if taken is not None else left.select(name, F.lit(0).cast("long").alias("gain"))
