"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _rounds(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u > v)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Only the edges from a node to larger ones move; a hub's are split by AQE, as one side has a row for each node.
    large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node of ``edges`` that isn't the smallest of its component.

    Edges and labels stay in tables in the shared folder, the result in one that ``discard`` deletes; the driver sees two
    numbers a round. Loops and repeated edges are harmless; an empty table gives an empty result.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    seen = None
    for _ in range(max_rounds):
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, total) == seen:
            out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out._shared_path = now._shared_path
            return out
        seen, before, now = (n, total), now, materialise(_rounds(now))
        discard(before)
    raise RuntimeError("components did not settle")
