"""Intervals on timelines: overlap joins, windows, merging, snapping.

Range joins cut both sides into buckets of a width that the caller picks near the usual length, join on key and bucket,
and keep each pair in the first bucket that both reach, so a pair comes out once and nothing is compared across the
whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import ordered, plain, scanned


def _bucketed(rows: DataFrame, start: str, end: str, width: float, name: str) -> DataFrame:
    lo, hi = F.floor(F.col(start) / width).cast("long"), F.floor(F.greatest(F.col(start), F.col(end)) / width).cast("long")
    return rows.withColumn(f"{name}_lo", lo).withColumn("_bucket", F.explode(F.sequence(lo, hi)))


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], width: float, a: tuple[str, str] = ("start", "end"), b: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap: ``b.start < a.end and b.end > a.start``."""
    x, y = _bucketed(left, *a, width, "_a"), _bucketed(right, *b, width, "_b")
    both = x.join(y, [*key, "_bucket"])
    first = F.col("_bucket") == F.greatest("_a_lo", "_b_lo")
    return both.where(first & (F.col(b[0]) < F.col(a[1])) & (F.col(b[1]) > F.col(a[0]))).drop("_bucket", "_a_lo", "_b_lo")


def overlap_share(windows: DataFrame, right: DataFrame, key: list[str], window_id: str, width: float) -> DataFrame:
    """Part of each window that intervals cover, summed."""
    cover = F.sum(F.greatest(F.lit(0.0), F.least("end", "r_end") - F.greatest("start", "r_start")))
    found = overlap_join(windows, right, key, width).groupBy(*key, window_id).agg(cover.alias("covered"))
    return windows.join(found, [*key, window_id], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0))).withColumn("share", F.when(F.col("end") > F.col("start"), F.col("covered") / (F.col("end") - F.col("start"))).otherwise(0.0))


def not_covered(left: DataFrame, right: DataFrame, key: list[str], row_id: str, width: float) -> DataFrame:
    """Intervals that overlap none of the others."""
    return left.join(overlap_join(left, right, key, width).select(row_id).distinct(), row_id, "left_anti")


def contained(left: DataFrame, right: DataFrame, key: list[str], row_id: str, width: float) -> DataFrame:
    """Intervals that lie wholly within one of the others."""
    inside = overlap_join(left, right, key, width).where("start >= r_start and `end` <= r_end")
    return left.join(inside.select(row_id).distinct(), row_id, "left_semi")


def joined_labels(windows: DataFrame, right: DataFrame, key: list[str], window_id: str, label: str, width: float) -> DataFrame:
    """Labels that overlap each window, in their order."""
    met = overlap_join(windows, right.where(F.trim(label) != ""), key, width)
    listed = F.array_sort(F.collect_list(F.struct("r_start", "r_end", label)))
    return met.groupBy(*key, window_id).agg(F.array_join(F.transform(listed, lambda x: x[label]), " ").alias("labels"))


def snap_to_edges(points: DataFrame, words: DataFrame, key: list[str], row_id: str, t: str, tolerance: float, width: float) -> DataFrame:
    """Each point moved to the nearer edge of the word it lies in, if near enough; the left edge wins ties."""
    p = points.withColumn("start", F.col(t)).withColumn("end", F.col(t))
    x = _bucketed(p, "start", "end", width, "_a")
    y = _bucketed(words.withColumnsRenamed({"start": "r_start", "end": "r_end"}), "r_start", "r_end", width, "_b")
    met = x.join(y, [*key, "_bucket"]).where(f"r_start < {t} and {t} < r_end")
    left, right = F.col(t) - F.col("r_start"), F.col("r_end") - F.col(t)
    moved = F.when((left <= right) & (left <= tolerance), F.col("r_start")).when((right < left) & (right <= tolerance), F.col("r_end"))
    one = met.groupBy(row_id).agg(F.min(moved).alias("_to"))
    return points.join(one, row_id, "left").withColumn("snapped", F.coalesce("_to", F.col(t))).drop("_to")


def sliding_windows(rows: DataFrame, start: str, end: str, size: int, stride: int) -> DataFrame:
    """Windows every ``stride``; the last is clipped and ends the row (E2). Numbers of windows: 1 + ceil((length - size) / stride)."""
    n = 1 + F.ceil(F.greatest(F.lit(0), F.col(end) - F.col(start) - size) / stride)
    i = F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    out = rows.where(F.col(end) > F.col(start)).withColumn("window_no", i)
    lo = F.col(start) + F.col("window_no") * stride
    return out.withColumn("window_start", lo).withColumn("window_end", F.least(F.col(end), lo + size))


def tumbling(rows: DataFrame, start: str, end: str, size: int, least: int = 0) -> DataFrame:
    """Parts of at most ``size``; a last part shorter than ``least`` is dropped."""
    n = F.ceil((F.col(end) - F.col(start)) / size)
    out = rows.where(F.col(end) > F.col(start)).withColumn("part", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    lo = F.col(start) + F.col("part") * size
    out = out.withColumn("part_start", lo).withColumn("part_end", F.least(F.col(end), lo + size))
    return out.where((F.col("part_end") - F.col("part_start") == size) | (F.col("part_end") - F.col("part_start") >= least))


def islands(rows: DataFrame, key: list[str], start: str, end: str, gap: float, order: list[str] = ()) -> DataFrame:
    """``island`` of each row: a new one starts where the gap to everything before exceeds ``gap`` (E4, I6); a key may have any number of rows."""
    return plain(_islands(rows, key, start, end, gap, order)).drop("_reach", "_new")


def _islands(rows: DataFrame, key: list[str], start: str, end: str, gap: float, order: list[str] = ()) -> DataFrame:
    found = scanned(ordered(rows, key, [start, end, *order]), _reach=("max_before", F.col(end)))
    new = F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > gap), 1).otherwise(0)
    return scanned(found.withColumn("_new", new), island=("sum", F.col("_new")))


def merge_gaps(rows: DataFrame, key: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Merged intervals, how many each holds, and the largest gap inside."""
    found = _islands(rows, key, start, end, gap).withColumn("_gap", F.greatest(F.lit(0), F.col(start) - F.col("_reach")))
    inner = F.when(F.col("_gap") <= gap, F.col("_gap")).otherwise(0)
    return found.groupBy(*key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"), F.coalesce(F.max(inner), F.lit(0)).alias("max_gap"))


def clips(rows: DataFrame, key: list[str], start: str, end: str, gap: int, longest: int, least: int) -> DataFrame:
    """Regions merged over gaps of at most ``gap``, cut into parts of at most ``longest``; parts shorter than ``least`` go (E6: what follows the regions)."""
    parts = tumbling(merge_gaps(rows, key, start, end, gap).select(*key, "start", "end"), "start", "end", longest, least)
    return parts.where(F.col("part_end") - F.col("part_start") >= least).select(*key, F.col("part_start").alias("start"), F.col("part_end").alias("end"))


def group_by_gaps(rows: DataFrame, key: list[str], start: str, end: str, join: float, split: float) -> DataFrame:
    """Small gaps joined first, then groups of regions split at large gaps (E5)."""
    joined = merge_gaps(rows, key, start, end, join).select(*key, "start", "end")
    return islands(joined, key, "start", "end", split).withColumnRenamed("island", "group_no")


def runs(rows: DataFrame, key: list[str], order: list[str], label: str) -> DataFrame:
    """Runs of equal labels: number, label, first and last place, length."""
    w = W.partitionBy(*key).orderBy(*order)
    change = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_i", F.row_number().over(w))
    return marked.groupBy(*key, "run").agg(F.first(label).alias(label), F.min("_i").alias("first_place"), F.max("_i").alias("last_place"), F.count("*").alias("n"))


def speech_ratio(rows: DataFrame, key: list[str], start: str, end: str, total: str) -> DataFrame:
    """Sum of region lengths over the total, within 0 and 1."""
    part = F.sum(F.col(end) - F.col(start)) / F.greatest(F.lit(1), F.max(total))
    return rows.groupBy(*key).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part)).alias("speech_ratio"))


def stretched(start: Column, end: Column, least: float) -> Column:
    """The end moved so that the interval has a least length."""
    return F.greatest(end, start + least)


def padded(start: Column, end: Column, pad: float, least: float, limit: Column) -> tuple[Column, Column]:
    """Padding within 0 and the limit, then even growth to a least length."""
    lo, hi = F.greatest(F.lit(0), start - pad), F.least(limit, end + pad)
    need = F.greatest(F.lit(0), least - (hi - lo)) / 2
    return F.greatest(F.lit(0), lo - need), F.least(limit, hi + need)


def even_parts(start: Column, end: Column, n: Column, step: int = 2) -> Column:
    """A span split evenly for every ``step`` of ``n`` units."""
    parts = F.greatest(F.lit(1), F.ceil(n / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct((start + (end - start) * i / parts).alias("start"), (start + (end - start) * (i + 1) / parts).alias("end")))


def snap_to_minima(bounds: DataFrame, frames: DataFrame, key: list[str], row_id: str, t: str, reach: float) -> DataFrame:
    """Each boundary moved to the frame of least energy within ``reach``, the earliest on ties."""
    x = bounds.withColumn("start", F.col(t) - reach).withColumn("end", F.col(t) + reach)
    y = frames.withColumn("r_start", F.col("frame_t")).withColumn("r_end", F.col("frame_t") + 1e-9)
    one = overlap_join(x, y, key, max(reach * 2, 1e-3)).groupBy(row_id).agg(F.min_by("frame_t", F.struct("rms", "frame_t")).alias("_to"))
    return bounds.join(one, row_id, "left").withColumn("snapped", F.coalesce("_to", F.col(t))).drop("_to")


def neighbours(rows: DataFrame, key: list[str], order: list[str], label: str) -> DataFrame:
    """Labels before and after each row."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("prev", F.lag(label).over(w)).withColumn("next", F.lead(label).over(w))


def positions(rows: DataFrame, key: list[str], place: str, is_vowel: str) -> DataFrame:
    """Onset, nucleus or coda by the first and last vowel of each chunk (E18); a chunk may have any number of rows."""
    vowel = F.when(F.col(is_vowel), F.col(place))
    found = scanned(ordered(rows, key, [place]), _seen=("last", vowel), _ahead=("next", vowel))
    onset = F.col("_seen").isNull() & (F.col("_ahead").isNull() | (F.col("_ahead") > F.col(place)))
    coda = F.col("_ahead").isNull() & (F.col("_seen") < F.col(place))
    return plain(found.withColumn("position", F.when(onset, "onset").when(coda, "coda").otherwise("nucleus"))).drop("_seen", "_ahead")


def uniform_windows(t: Column, n: int, overlap: float) -> Column:
    """``n`` windows of equal length over 0..t, each widened by a share of it."""
    size = t / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.greatest(F.lit(0.0), size * i - size * overlap).alias("start"), F.least(t, size * (i + 1) + size * overlap).alias("end")))
