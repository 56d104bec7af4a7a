"""Leak-free splits, shards, buckets and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(key: str | Column, seed: str) -> Column:
    """A hash that any engine computes alike; orders rows in a fixed random way, null keys first."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def _named(rank: Column, n: Column, ratios: dict[str, float]) -> Column:
    """Split of a 1-based rank among n: counts are rounded half to even, what is left goes to the last split."""
    out, low, names = None, F.lit(0), list(ratios)
    for name in names[:-1]:
        low = low + F.bround(n * ratios[name]).cast("long")
        out = F.when(rank <= low, name) if out is None else out.when(rank <= low, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def stratified_split(rows: DataFrame, label: list[str], key: str, ratios: dict[str, float], seed: str) -> DataFrame:
    """``split`` of each row, in the same proportions within each label.

    Ranks come from range partitions of (label, hash) and their sizes, so a label with most rows is no task of its own.
    Labels are counted first; their table is as large as there are labels.
    """
    from .records import dense_ids

    numbered = dense_ids(rows, [*map(F.col, label), seeded(key, seed), F.col(key)])
    sizes = numbered.groupBy(*label).agg(F.min("id").alias("_first"), F.count("*").alias("_n"))
    both = numbered.alias("r").join(sizes.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in label])
    return both.select(*(F.col(f"r.{c}") for c in rows.columns), _named(F.col("id") - F.col("_first") + 1, F.col("_n"), ratios).alias("split"))


def group_split(rows: DataFrame, group: str, ratios: dict[str, float], seed: str) -> DataFrame:
    """``split`` of each row, all rows of a group in the same one (F8); groups are ranked over range partitions.

    Rows without a group are one group. As many rows as there are groups are joined; partitions of frequent groups are split at
    run time.
    """
    from .records import dense_ids

    groups = dense_ids(rows.select(group).distinct(), [seeded(group, seed), F.col(group)])
    n = groups.agg(F.count("*").alias("_n"))
    named = groups.join(F.broadcast(n)).select(group, _named(F.col("id") + 1, F.col("_n"), ratios).alias("split"))  # one row
    named = named.select(F.struct(group).alias("_group"), "split")  # a struct is never null
    return rows.withColumn("_group", F.struct(group)).join(named, "_group").drop("_group")


def hashed_split(rows: DataFrame, group: str, ratios: dict[str, float], seed: str) -> DataFrame:
    """As ``group_split`` by thresholds on the hash itself: no shuffle, proportions met on average only."""
    share = F.conv(F.substring(seeded(group, seed), 1, 8), 16, 10).cast("double") / 2**32
    out, low = None, 0.0
    for name, r in list(ratios.items())[:-1]:
        low += r
        out = F.when(share < low, name) if out is None else out.when(share < low, name)
    return rows.withColumn("split", out.otherwise(list(ratios)[-1]))


def with_reserved(split: DataFrame, reserved: DataFrame, name: str) -> DataFrame:
    """Reserved rows added to one split."""
    return split.unionByName(reserved.withColumn("split", F.lit(name)), allowMissingColumns=True)


def contiguous_shards(rows: DataFrame, n: int, order: str) -> DataFrame:
    """``shard`` of each row: runs of equal size (rounded up) in the order given."""
    from .records import dense_ids

    total = rows.count()
    return dense_ids(rows, [F.col(order)]).withColumn("shard", F.floor(F.col("id") / max(1, -(-total // n)))).drop("id")


def round_robin(rows: DataFrame, n: int, order: str) -> DataFrame:
    """``shard`` of each row: every n-th row in the order given."""
    from .records import dense_ids

    return dense_ids(rows, [F.col(order)]).withColumn("shard", F.col("id") % n).drop("id")


def length_buckets(rows: DataFrame, length: str, bounds: list[int]) -> DataFrame:
    """``bucket`` i with bounds[i] < length <= bounds[i + 1]; rows outside are left out."""
    out = None
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        inside = (F.col(length) > lo) & (F.col(length) <= hi)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return rows.withColumn("bucket", out).where(F.col("bucket").isNotNull())


def padded_sizes(bucketed: DataFrame, multiple: int) -> DataFrame:
    """Rows of each bucket and their number rounded up to a multiple."""
    one = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    return one.withColumn("padded", (F.ceil(F.col("n") / multiple) * multiple).cast("long"))


def fill_quotas(rows: DataFrame, slot: str, order: list[str], target: int) -> DataFrame:
    """At most ``target`` rows of each slot."""
    rank = F.row_number().over(W.partitionBy(slot).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= target)


def shortfall(filled: DataFrame, targets: DataFrame, slot: str) -> DataFrame:
    """Targets (slot, target), rows got and rows missing."""
    got = filled.groupBy(slot).agg(F.count("*").alias("got"))
    return targets.join(got, slot, "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).withColumn("missing", F.greatest(F.lit(0), F.col("target") - F.col("got")))


def round_robin_fill(rows: DataFrame, slots: int, order: str) -> DataFrame:
    """Leftover rows dealt over slots in turn."""
    return round_robin(rows, slots, order).withColumnRenamed("shard", "slot")


def usable_lengths(rows: DataFrame, text: str, size: str, least: int, most: int, bytes_per_frame: int) -> DataFrame:
    """Rows whose text has a length within bounds, with the number of frames estimated from their file's size."""
    return rows.where(F.length(text).between(least, most)).withColumn("frames", F.floor(F.col(size) / bytes_per_frame))
