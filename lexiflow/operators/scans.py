"""Running values over the rows of a key in order, however many rows a key has.

Rows are spread over ranges of (key, order) and written once, so that a frequent key lies in many ranges. Values run
within the rows of a key in one range; one row for each key and range carries what comes before (or after) it, and is
joined back. No task holds more than a range, and a key has as many carried rows as ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import shared_table

LAYOUT = ("_part", "_key", "_n")


def ordered(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """``rows`` in the layout that ``scanned`` reads; null keys are one key, and equal places keep any order within one range."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    # A struct of the key is never null, so joins and windows treat null keys as one.
    return shared_table(spread.withColumn("_part", F.spark_partition_id()).withColumn("_key", F.struct(*key)).withColumn("_n", F.monotonically_increasing_id()))


def scanned(rows: DataFrame, **values: tuple[str, Column]) -> DataFrame:
    """Rows of ``ordered`` with a column for each of ``values``, a kind and what it runs over.

    ``sum``, ``max``, ``min``: of all rows of the key up to this one; ``max_before``: of those before it. ``last``: the last one
    that isn't null, this row's included; ``last_before``: without this row's. ``next``: the first one from this row on.
    ``before``, ``after``: of the neighbouring row, null or not. Nulls are passed over; without any value the result is null.
    The layout stays, so results can be scanned again.
    """
    here, over = W.partitionBy("_part", "_key").orderBy("_n"), W.partitionBy("_key").orderBy("_part")
    upto, past = (here.rowsBetween(W.unboundedPreceding, b) for b in (0, -1))
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    # What lies ahead runs backwards: a frame that ends with the last row is made anew for each row, in the square of a range's rows.
    ahead = W.partitionBy("_part", "_key").orderBy(F.desc("_n")).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("_key").orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    local, partial, carried, joined = {}, [], [], {}
    for name, (kind, value) in values.items():
        p, c, own = f"_p_{name}", f"_c_{name}", F.col(f"_l_{name}")
        seen = F.when(value.isNotNull(), F.col("_n"))
        if kind == "sum":
            made = (F.sum(value).over(upto), F.sum(value), F.sum(p).over(earlier), F.coalesce(own + F.col(c), own, F.col(c)))
        elif kind in ("max", "max_before"):
            made = (F.max(value).over(past if kind == "max_before" else upto), F.max(value), F.max(p).over(earlier), F.greatest(own, c))
        elif kind == "min":
            made = (F.min(value).over(upto), F.min(value), F.min(p).over(earlier), F.least(own, c))
        elif kind in ("last", "last_before"):
            made = (F.last(value, True).over(past if kind == "last_before" else upto), F.max_by(value, seen), F.last(p, True).over(earlier), F.coalesce(own, c))
        elif kind == "next":
            made = (F.last(value, True).over(ahead), F.min_by(value, seen), F.last(p, True).over(later), F.coalesce(own, c))
        elif kind in ("before", "after"):
            boxed = F.struct(value.alias("v"))
            if kind == "before":
                made = (F.lag(boxed).over(here), F.max_by(boxed, "_n"), F.last(p).over(over.rowsBetween(-1, -1)), F.coalesce(own, c)["v"])
            else:
                made = (F.lead(boxed).over(here), F.min_by(boxed, "_n"), F.first(p).over(over.rowsBetween(1, 1)), F.coalesce(own, c)["v"])
        else:
            raise ValueError(f"no scan {kind}")
        local[f"_l_{name}"] = made[0]
        partial.append(made[1].alias(p))
        carried.append(made[2].alias(c))
        joined[name] = made[3]
    carry = rows.groupBy("_part", "_key").agg(*partial).select("_part", "_key", *carried)
    return rows.withColumns(local).join(carry, ["_part", "_key"]).withColumns(joined).drop(*local, *(f"_c_{x}" for x in values))


def plain(rows: DataFrame) -> DataFrame:
    """Without the columns of the layout."""
    return rows.drop(*LAYOUT)


def first_reaching(rows: DataFrame, probes: DataFrame, key: list[str], value: str, at: str, found: list[str], strict: bool = False) -> DataFrame:
    """``probes`` (key, ``at``, ...) with a struct ``reached``: columns ``found`` of the key's first row whose value isn't below ``at`` (``strict``: is above it).

    An as-of join: rows and probes run in one order of values, and each probe takes the next row. Probes without one have null,
    those with a null ``at`` too.
    """
    mine = [c for c in probes.columns if c not in (*key, at)]
    side = F.lit(1 if strict else -1)
    left = probes.select(*key, F.col(at).alias("_v"), side.alias("_side"), F.struct(*mine).alias("_mine"), F.lit(None).cast(rows.select(F.struct(*found).alias("x")).schema["x"].dataType).alias("_row"))
    right = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_mine"].dataType).alias("_mine"), F.struct(*found).alias("_row"))
    both = ordered(left.unionByName(right), key, ["_v", "_side", "_row"])
    done = plain(scanned(both, reached=("next", F.col("_row"))).where("_side <> 0"))
    return done.select(*key, F.col("_v").alias(at), *(F.col(f"_mine.{c}").alias(c) for c in mine), F.when(F.col("_v").isNotNull(), F.col("reached")).alias("reached"))
