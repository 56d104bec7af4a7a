"""Latest records, queues, counters, pages, top-k and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key; ``order`` ends with the arrival so that later rows win ties.

    One aggregate with map-side combine, so a frequent key costs one row a task.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in rows.columns if c not in key]
    one = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return one.select(*key, "_r.*")


def counted(items: DataFrame, log: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Items with the number of log rows of their key, 0 without any."""
    return items.join(log.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def open_queue(items: DataFrame, log: DataFrame, key: str, enough: int = 5) -> DataFrame:
    """Items with fewer than ``enough`` log rows, and how many are to come."""
    return counted(items, log, key, "done").where(F.col("done") < enough).withColumn("remaining", F.greatest(F.lit(0), enough - F.col("done")))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A slice of the ordered rows (F2, F13); Spark keeps offset + limit rows of each task only."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_counts(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """``total`` rows before slicing and ``returned`` rows of the page (F2)."""
    n = F.count("*")
    return rows.agg(n.alias("total"), F.greatest(F.lit(0), F.least(F.lit(limit), n - offset)).cast("long").alias("returned"))


def ordinal(rows: DataFrame, key: list[str], order: list[str], final: int = 5) -> DataFrame:
    """Each row's number among those of its key so far, and whether it completes it (D19); a key may have any number of rows."""
    from .scans import ordered, plain, scanned

    numbered = plain(scanned(ordered(rows, key, order), count_after=("sum", F.lit(1))))
    return numbered.withColumn("finalize", F.col("count_after") >= final)


def profile(rows: DataFrame, key: str, amount: str, ts: str) -> DataFrame:
    """Rows, sum and last time of each key."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.max(ts).alias("last_ts"))


def last_n(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key (B28, E22); ``order`` runs from the newest."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    """Count and share of each value."""
    one = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = one.agg(F.sum("n").alias("total"))
    return one.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.greatest(F.lit(1), F.col("total"))).alias("share"))  # one row


def top_values(rows: DataFrame, column: str, seq: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values, ties in the order first seen."""
    one = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(seq).alias("first_seen"))
    return one.orderBy(F.col("n").desc(), "first_seen").limit(k)


def top_per_key(tokens: DataFrame, key: str, token: str, place: str, k: int, stop: list[str]) -> DataFrame:
    """The ``k`` most frequent tokens of each key, ties by first place, stop words left out."""
    one = tokens.where(~F.col(token).isin(stop)).groupBy(key, token).agg(F.count("*").alias("n"), F.min(place).alias("first_place"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("n").desc(), "first_place"))
    return one.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def token_frequencies(tokens: DataFrame, token: str, min_length: int = 1, min_count: int = 1) -> DataFrame:
    """Counts of tokens of a least length and frequency."""
    return tokens.where(F.length(token) >= min_length).groupBy(token).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def ids_by_appearance(tokens: DataFrame, token: str, seq: list[str]) -> DataFrame:
    """Dense ids of distinct tokens from 0 in the order first seen.

    Numbers come from ranges: rows are sorted over partitions, each adds the sizes of those before it.
    """
    first = tokens.groupBy(token).agg(F.min(F.struct(*seq)).alias("first"))
    return dense_ids(first, [F.col("first")]).select(token, "id")


def ids_by_order(tokens: DataFrame, token: str) -> DataFrame:
    """Dense ids of distinct tokens from 0 in sorted order."""
    return dense_ids(tokens.select(token).distinct(), [F.col(token)])


def dense_ids(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``id`` from 0 in the order given, without a window over all rows in one task."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    from ..sources.tables import shared_table  # rows must keep their partitions between the two uses

    held = shared_table(spread)
    sizes = held.groupBy("_part").agg(F.count("*").alias("_c"), F.min("_n").alias("_low"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return held.join(F.broadcast(before.drop("_c")), "_part").withColumn("id", F.col("_n") - F.col("_low") + F.col("_before")).drop("_part", "_n", "_low", "_before")


def exact_quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """One row ``threshold``: the quantile of the numbers with linear interpolation, from range partitions of distinct values and their counts."""
    from ..sources.tables import shared_table  # values must keep their partitions between the two uses

    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    held = shared_table(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = held.groupBy("part").agg(F.sum("n").alias("c"))
    before = F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = F.lit(q) * (F.sum("c").over(W.partitionBy()) - 1)
    sizes = sizes.select("part", "c", before.alias("before"), at.alias("at"))  # a row for each partition
    low, high = F.floor("at"), F.ceil("at")
    sizes = sizes.where((F.col("before") <= high) & (F.col("before") + F.col("c") > low)).drop("c")  # at most two partitions
    run = held.join(F.broadcast(sizes), "part").withColumn("end", F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    here = lambda k: F.max(F.when((k < F.col("end")) & (k >= F.col("end") - F.col("n")), F.col("v")))
    found = run.agg(here(low).alias("lo"), here(high).alias("hi"), F.max("at").alias("at"))
    return found.select(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((high - F.col("at")) * F.col("lo") + (F.col("at") - low) * F.col("hi")).alias("threshold"))


def quantile_classes(rows: DataFrame, value: str, q: float, low: int = 2, high: int = 3) -> DataFrame:
    """Two classes by an exact quantile with linear interpolation."""
    cut = exact_quantile(rows, value, q)
    return rows.join(F.broadcast(cut)).withColumn("score", F.when(F.col(value) >= F.col("threshold"), high).otherwise(low))  # one row


def best_and_margin(scores: DataFrame, options: list[str], gold: str) -> DataFrame:
    """The option with the largest value (ties: first in order) and gold minus the best other."""
    pairs = F.array(*(F.struct(F.col(o).alias("v"), F.lit(-i).alias("i"), F.lit(o).alias("name")) for i, o in enumerate(options)))
    best = F.array_max(pairs)
    others = F.array_max(F.transform(F.filter(pairs, lambda p: p["name"] != F.col(gold)), lambda p: p["v"]))
    own = F.get(F.transform(F.filter(pairs, lambda p: p["name"] == F.col(gold)), lambda p: p["v"]), F.lit(0))
    return scores.withColumn("pred", best["name"]).withColumn("margin", own - others)


def accuracy(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Share of equal labels, 0 without rows."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col(gold) == F.col(pred)).cast("int")), F.lit(0.0)).alias("accuracy"))


def range_rules(rows: DataFrame, rules: DataFrame, value: str, most: int = 10_000) -> DataFrame:
    """Each row with the first rule (lo, hi, idx, ..) whose range holds its value.

    At most ``most`` rules (more are an error) become one array that is broadcast; rows aren't shuffled, equal ones stay.
    """
    n = rules.count()
    if n > most:
        raise ValueError(f"{n} rules, {most} are allowed")
    names = [c for c in rules.columns if c not in ("lo", "hi")]
    table = rules.agg(F.array_sort(F.collect_list(F.struct("idx", "lo", "hi", F.struct(*names).alias("rule")))).alias("_rules"))
    first = F.get(F.filter("_rules", lambda r: F.col(value).between(r["lo"], r["hi"])), F.lit(0))
    return rows.join(F.broadcast(table)).withColumn("_r", first["rule"]).select(*rows.columns, "_r.*")  # one row


def groups_with_all(rows: DataFrame, group: str, member: str, wanted: list) -> DataFrame:
    """Groups that hold every wanted member: relational division (C17)."""
    have = rows.where(F.col(member).isin(wanted)).groupBy(group).agg(F.collect_set(member).alias("have"))
    return have.where(F.size(F.array_except(F.array(*map(F.lit, wanted)), "have")) == 0).select(group)


def excluding_recent(pool: DataFrame, recent: DataFrame, key: str) -> DataFrame:
    """Pool rows not seen recently, or all of them if none would be left."""
    fresh = pool.join(recent.select(key).distinct(), key, "left_anti")
    any_left = fresh.limit(1).agg((F.count("*") > 0).alias("any"))
    marked = pool.join(recent.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left").join(F.broadcast(any_left))  # one row
    return marked.where(F.col("_seen").isNull() | ~F.col("any")).select(pool.columns)


def seeded_choice(pool: DataFrame, key: str, seed: str, n: int = 1) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the key."""
    return pool.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def lookup_with_fallback(rows: DataFrame, lexicon: DataFrame, key: str, value: str, fallback: Column) -> DataFrame:
    """Lexicon value of each row, or the fallback."""
    return rows.join(lexicon.select(key, value), key, "left").withColumn(value, F.coalesce(value, fallback))


def first_match(rows: DataFrame, listing: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the first listed entry of its key."""
    rest = [c for c in listing.columns if c != key]
    first = listing.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return rows.join(first, key, "left").select(*rows.columns, "_r.*")


def remaining(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(*key), key, "left_anti")


def with_file(rows: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose file exists."""
    return rows.join(files.select(*key), key, "left_semi")


def oov(tokens: DataFrame, lexicon: DataFrame, token: str, min_count: int = 1) -> DataFrame:
    """Frequent tokens that the lexicon lacks (C11)."""
    return token_frequencies(tokens, token, 1, min_count).join(lexicon.select(token), token, "left_anti")


def description(rows: DataFrame, records: DataFrame, key: str, want: str, order: tuple[str, ...] = ("ko", "vi", "en")) -> DataFrame:
    """Text of each key in the wanted language, else in the first of ``order`` that has one, else any."""
    found = rows.join(records, key, "left")
    picks = [F.element_at("desc", x) for x in dict.fromkeys((want, *order))]
    return found.withColumn("text", F.coalesce(*(F.when(F.trim(p) != "", p) for p in picks), F.get(F.map_values("desc"), F.lit(0))))


def zip_priors(rows: DataFrame, segments: str, priors: str) -> DataFrame:
    """Segments with the prior at their place if there are as many, else with an even split of the span."""
    n, lo, hi = F.size(priors), F.get(segments, F.lit(0))["start"], F.try_element_at(segments, F.lit(-1))["end"]
    even = F.transform(priors, lambda p, i: F.struct((lo + (hi - lo) * i / n).alias("start"), (lo + (hi - lo) * (i + 1) / n).alias("end"), p.alias("prior")))
    same = F.zip_with(segments, priors, lambda s, p: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end"), p.alias("prior")))
    return rows.withColumn("zipped", F.when(F.size(segments) == n, same).otherwise(even))


def bundles(items: DataFrame, group: str, order: str, score: str) -> DataFrame:
    """Items of each group as one ordered array, with their number and total score."""
    rest = [c for c in items.columns if c != group]
    one = F.array_sort(F.collect_list(F.struct(order, *(c for c in rest if c != order)))).alias("items")
    return items.groupBy(group).agg(F.count("*").alias("n_items"), F.sum(score).alias("score_total"), one)
