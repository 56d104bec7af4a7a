"""Signatures, deduplication, unions and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered_signature(*parts: str | Column, sep: str = "|") -> Column:
    """MD5 of the parts in their order; null counts as empty."""
    return F.md5(F.concat_ws(sep, *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts)))


def unordered_signature(*heads: str | Column, options: str | Column, sep: str = "||") -> Column:
    """MD5 of the heads and the sorted options, so that their order doesn't count."""
    plain = F.array_sort(F.transform(options, lambda x: F.coalesce(x, F.lit(""))))
    return F.md5(F.concat_ws(sep, *(F.coalesce(F.col(h) if isinstance(h, str) else h, F.lit("")) for h in heads), F.array_join(plain, sep)))


def first_of(rows: DataFrame, key: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of each key (G3-G6). One aggregate with map-side combine: copies of one key meet as one row a task."""
    keyed = rows.select(F.struct(*(F.col(k) if isinstance(k, str) else k for k in key)).alias("_k"), F.struct(*order).alias("_o"), F.struct("*").alias("_r"))
    return keyed.groupBy("_k").agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def duplicates_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows after the first of their key, with their number among the copies."""
    rn = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("copy", rn.cast("long")).where("copy > 1")


def union_all(tables: list[DataFrame], fill: str | None = None) -> DataFrame:
    """Rows of all tables by column name; columns that a table lacks are null, or ``fill`` for strings."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out if fill is None else out.na.fill(fill)


def union_distinct(tables: list[DataFrame], column: str) -> DataFrame:
    """Distinct values of a column over all tables, sorted."""
    return union_all([t.select(column) for t in tables]).distinct().orderBy(column)


def distinct_in_order(array: str | Column, limit: int | None = None) -> Column:
    """Distinct elements in the order first seen, at most ``limit``."""
    out = F.array_distinct(array)
    return out if limit is None else F.slice(out, 1, limit)


def merge_lexicons(tables: list[DataFrame], limit: int) -> DataFrame:
    """Variants of each word over all lexicons in their order, distinct, at most ``limit``."""
    every = union_all([t.select("word", "phones", F.lit(i).alias("source"), "line_no") for i, t in enumerate(tables)])
    once = every.groupBy("word", "phones").agg(F.min(F.struct("source", "line_no")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "phones")))
    return once.groupBy("word").agg(F.slice(F.transform(listed, lambda x: x["phones"]), 1, limit).alias("variants"))


def merge_maps(rows: DataFrame, key: list[str], field: str, value: str, order: list[str]) -> DataFrame:
    """A map for each key with the latest value of each field."""
    one = rows.groupBy(*key, field).agg(F.max_by(value, F.struct(*order)).alias(value))
    return one.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("merged"))


def migrate_explanation(rows: DataFrame, old: str, new: str, language: str) -> DataFrame:
    """An old single text as a map with one language where the map is missing."""
    return rows.withColumn(new, F.when(F.col(new).isNull() & F.col(old).isNotNull(), F.create_map(F.lit(language), F.col(old))).otherwise(F.col(new))).drop(old)


def missing_keys(keys: str | Column, required: list[str]) -> Column:
    """Required keys that are not there."""
    return F.array_except(F.array(*map(F.lit, required)), keys)


def update_by_key(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null fields of their update (A8); write the result to a new folder."""
    fields = [c for c in updates.columns if c != key and c in rows.columns]
    other = updates.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields))
    return rows.join(other, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields}).select(rows.columns)
