"""Event tracking: conjunctive filters, conditional aggregates, idempotent inserts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the predicates given; None stands for no filter (B1)."""
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def _of(kind: str, value: Column) -> Column:
    return F.when(F.col("event_type") == kind, value)


def summary_columns() -> list[Column]:
    """Aggregates of the tracking summary: nulls are ignored by averages, an empty set gives 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    mean = lambda kind, c: F.round(F.coalesce(F.avg(_of(kind, F.col(c))), F.lit(0.0)).cast("decimal(20,10)"), 4).cast("double")  # noqa: E731  (as decimals: the order of sums doesn't show)
    latest = lambda kind: zero(F.max(_of(kind, F.col("duration_ms")))).cast("long")
    answered = F.count(_of("topik_answered", F.lit(1)))
    correct = zero(F.sum(_of("topik_answered", F.when(F.col("is_correct"), 1).otherwise(0))))
    return [
        F.count(_of("chat_turn", F.lit(1))).alias("chat_turns"),
        latest("chat_turn").alias("chat_latency_max_ms"),
        F.count(_of("pronun_scored", F.lit(1))).alias("pronun_attempts"),
        latest("pronun_scored").alias("pronun_latency_max_ms"),
        mean("pronun_scored", "score_overall").alias("pronun_score_avg"),
        mean("pronun_scored", "cer").alias("pronun_cer_avg"),
        answered.alias("topik_answered"),
        correct.alias("topik_correct"),
        F.when(answered > 0, F.round(correct / answered, 4)).otherwise(0.0).alias("topik_accuracy"),
        latest("topik_answered").alias("topik_latency_max_ms"),
    ]


def tracking_summary(events: DataFrame, session_id: str | None = None) -> DataFrame:
    """One row for all events or for one session (a blank id is no filter); a session counts as one even without rows."""
    chosen = events.where(all_of(F.col("session_id") == session_id if session_id else None))
    sessions = F.lit(1).cast("long") if session_id else F.count_distinct("session_id")
    return chosen.agg(sessions.alias("unique_sessions"), *summary_columns()).select(F.lit("session" if session_id else "global").alias("scope"), "*")


def tracking_summary_by(events: DataFrame, key: str = "session_id") -> DataFrame:
    return events.groupBy(key).agg(*summary_columns())


def first_inserts(events: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The first row of each key in the order given; later ones are duplicates (A24, G9). One aggregate with map-side combine."""
    from .dedup import first_of

    return first_of(events, [key], list(order))


def batch_insert(existing: DataFrame, batch: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Rows of ``batch`` to add: first of each key, keys of ``existing`` left out."""
    return first_inserts(batch, key, order).join(existing.select(key), key, "left_anti")


def insert_counts(existing: DataFrame, batch: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``created`` and ``duplicates`` of a batch insert."""
    marked = batch.select(key).withColumn("n", F.lit(1)).groupBy(key).agg(F.sum("n").alias("n"))
    known = existing.select(key).distinct().withColumn("known", F.lit(True))
    one = marked.join(known, key, "left")
    new = F.when(F.col("known").isNull(), 1).otherwise(0)
    return one.agg(F.coalesce(F.sum(new), F.lit(0)).alias("created"), F.coalesce(F.sum(F.col("n") - new), F.lit(0)).alias("duplicates"))


def prior_event(events: DataFrame, key: str = "idempotency_key", order: str = "ts") -> DataFrame:
    """Each row with the event id that first used its idempotency key; rows without a key keep their own.

    One aggregate with map-side combine and a join, which AQE splits for a key with very many rows.
    """
    first = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("event_id", F.struct(order, "event_id")).alias("_first"))
    return events.join(first, key, "left").select(*events.columns, F.coalesce("_first", "event_id").alias("prior_event_id"))


def store_once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each content hash of ``columns``, with the hash."""
    text = F.to_json(F.struct(*sorted(columns)))
    return rows.withColumn("content_hash", F.sha1(text)).dropDuplicates(["content_hash"])
