"""Greedy chains, where each start depends on the one before, for keys of any size.

What would come after a start is known for every row at once, by as-of joins and running values; which rows are starts
at all is then found by doubling pointers: in round k every start found so far adds the one 2^k steps on. Chains that
only ever skip one row need no rounds: a run of rows that could each take the next one alternates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, shared_table
from .scans import first_reaching, ordered, plain, scanned

#: Below every end of a row.
NOWHERE = -(1 << 62)


def reached(steps: DataFrame) -> DataFrame:
    """Places (_g, i) on the chains of ``steps`` (_g, i, to, first): those that are ``first``, and from each the place it goes ``to``.

    Places are unique in a group, ``to`` lies ahead or is null at a chain's end, and chains don't meet. Rounds: the logarithm
    of the longest chain; keys of the joins are single places, so no chain is in one task.
    """
    seen = shared_table(steps.where("first").select("_g", "i"))
    jump = shared_table(steps.where(F.col("to").isNotNull()).select("_g", "i", "to"))
    while not jump.isEmpty():
        more = seen.join(jump, ["_g", "i"]).select("_g", F.col("to").alias("i"))
        far = jump.withColumnRenamed("to", "via").join(jump.withColumnRenamed("i", "via"), ["_g", "via"]).select("_g", "i", "to")
        old = (seen, jump)
        seen, jump = shared_table(seen.unionByName(more)), shared_table(far)
        discard(*old)
    discard(jump)
    return seen


def _ordered(rows: DataFrame, key: list[str], order: list[str], *columns: Column) -> DataFrame:
    """``columns`` of rows in the layout of scans, the key as one struct ``_g``, which is never null and clashes with no name."""
    places = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    return ordered(rows.select(F.struct(*key).alias("_g"), *places, *columns), ["_g"], [f"_o{i}" for i in range(len(order))]).drop(*(f"_o{i}" for i in range(len(order))))


def packs(rows: DataFrame, key: list[str], order: list[str], start: str, end: str, silent: str, target: int, least: int, most: int, limit: str | None = None) -> DataFrame:
    """Intervals (key, start, end) of adjacent ones joined until ``target`` (E8), ends not decreasing in the given order.

    A silent row closes a pack. So does a row that ends beyond the ``limit`` of the row that the pack began with (null: none),
    the end of the word that it lies in: that row begins the next pack. Packs shorter than ``least`` are dropped, longer ones
    than ``most`` cut, a last part shorter than ``least`` dropped.
    """
    at = _ordered(rows, key, order, F.col(start).alias("s"), F.col(end).alias("e"), F.col(silent).alias("silent"), (F.col(limit) if limit else F.lit(None)).cast("long").alias("limit"))
    row = scanned(at, i=("sum", F.lit(1)), run=("sum", F.col("silent").cast("long")), _was=("before", F.col("silent")), _then=("after", F.col("silent")), before=("before", F.col("e")))
    last = F.when(~F.col("silent") & F.coalesce("_then", F.lit(True)), F.struct("i", "e"))
    row = shared_table(plain(scanned(row.withColumn("first", F.coalesce("_was", F.lit(True))), stop=("next", last)).where(~F.col("silent"))).select("_g", "run", "i", "s", "e", "before", "limit", "first", "stop"))
    inner = ["_g", "run"]
    full = first_reaching(row, row.select(*inner, "i", "s", "first", "limit", "stop", (F.col("s") + target).alias("x")), inner, "e", "x", ["i", "e"]).withColumnRenamed("reached", "full")
    if limit:
        left = first_reaching(row, full.select(*inner, "i", "s", "first", "stop", "full", F.col("limit").alias("x")), inner, "e", "x", ["i", "before"], strict=True).withColumnRenamed("reached", "over")
        # A row may itself end beyond its word; what comes after it leaves then.
        left = left.join(row.select("_g", "i", F.col("e").alias("own_e")), ["_g", "i"])
        away = F.when(F.col("over.i") > F.col("i"), F.struct(F.col("over.i").alias("i"), F.col("over.before").alias("e"))).when(F.col("over.i").isNotNull() & (F.col("stop.i") > F.col("i")), F.struct((F.col("i") + 1).alias("i"), F.col("own_e").alias("e")))
        full = left.withColumn("away", away).drop("over", "own_e")
    else:
        full = full.withColumn("away", F.lit(None).cast("struct<i:bigint,e:bigint>"))
    leaves = F.col("away").isNotNull() & (F.col("full").isNull() | (F.col("away.i") <= F.col("full.i")))
    to = F.when(leaves, F.col("away.i")).when(F.col("full").isNotNull() & (F.col("full.i") < F.col("stop.i")), F.col("full.i") + 1)
    done = F.when(leaves, F.col("away.e")).when(F.col("full").isNotNull(), F.col("full.e")).otherwise(F.col("stop.e"))
    steps = shared_table(full.select("_g", "i", "first", "s", done.alias("e"), to.alias("to")))
    made = steps.join(reached(steps), ["_g", "i"]).where(F.col("e") - F.col("s") >= least)
    n = F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("s")) / most))
    parts = made.select("_g", "s", "e", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    parts = parts.select("_g.*", (F.col("s") + F.col("k") * most).alias("start"), F.least(F.col("e"), F.col("s") + (F.col("k") + 1) * most).alias("end"))
    return parts.where(F.col("end") - F.col("start") >= F.least(F.lit(least), F.lit(most)))


def word_limits(rows: DataFrame, words: DataFrame, key: list[str], start: str, limit: str = "limit") -> DataFrame:
    """Rows with the largest end of a word (key, start, end) that begins no later than they do; null where a key has no words at all.

    A row before all words of its key lies in none: its limit is below everything.
    """
    row = rows.withColumn("_at", F.col(start)).withColumn("_end", F.lit(None).cast("long")).withColumn("_side", F.lit(1))
    word = words.select(*key, F.col("start").alias("_at"), F.col("end").cast("long").alias("_end"), F.lit(0).alias("_side"))
    both = ordered(row.unionByName(word, allowMissingColumns=True), key, ["_at", "_side"])
    found = scanned(both, **{limit: ("max", F.col("_end"))}, _later=("next", F.col("_end"))).where("_side = 1")
    return plain(found.withColumn(limit, F.when(F.col(limit).isNull() & F.col("_later").isNotNull(), F.lit(NOWHERE)).otherwise(F.col(limit)))).drop("_at", "_end", "_side", "_later")


def spliced(phones: DataFrame, key: list[str], order: list[str], start: str, end: str, vowel: Column, least: int, most: int) -> DataFrame:
    """Half-open runs (key, first, last) of phones up to a length, cut back to a vowel after a consonant (E9); places from 0."""
    at = _ordered(phones, key, order, F.col(start).alias("s"), F.col(end).alias("e"), vowel.alias("v"))
    row = scanned(at, i=("sum", F.lit(1)), _was=("before", F.col("v")), _then=("after", F.lit(True)))
    row = row.withColumn("i", F.col("i") - 1).withColumn("edge", F.when(F.col("v") & ~F.col("_was"), F.col("i")))
    row = shared_table(plain(scanned(row, cut=("last", F.col("edge")), n=("next", F.when(F.col("_then").isNull(), F.col("i") + 1)))).select("_g", "i", "s", "e", "cut", "n"))
    far = first_reaching(row, row.select("_g", "i", "s", "n", (F.col("s") + most).alias("x")), ["_g"], "e", "x", ["i"]).withColumn("far", F.coalesce("reached.i", "n")).drop("x", "reached")
    near = first_reaching(row, far.select("_g", "i", "n", "far", (F.col("s") + least).alias("x")), ["_g"], "e", "x", ["i"]).withColumn("near", F.coalesce(F.col("reached.i") + 1, "n")).drop("x", "reached")
    near = near.withColumn("p", F.least(F.col("far"), F.col("n") - 1)).join(row.select("_g", F.col("i").alias("p"), "cut"), ["_g", "p"])
    back = F.when(F.col("cut") > F.col("i") + 1, F.col("cut")).otherwise(F.col("far"))
    last = F.greatest(back, F.col("i") + 1, F.col("near"))
    steps = shared_table(near.select("_g", "i", (F.col("i") == 0).alias("first"), last.alias("last"), F.when(last < F.col("n"), last).alias("to")))
    return steps.join(reached(steps), ["_g", "i"]).select("_g.*", F.col("i").alias("first"), "last")


def groups_from_each(phones: DataFrame, key: list[str], order: list[str], start: str, end: str, least: int, most: int, fewest: int, stride: int = 1) -> DataFrame:
    """Overlapping half-open groups (key, first, last) of phones between two lengths, one from every ``stride``-th (E10); places from 0."""
    at = _ordered(phones, key, order, F.col(start).alias("s"), F.col(end).alias("e"))
    row = scanned(at, i=("sum", F.lit(1)), _then=("after", F.lit(True))).withColumn("i", F.col("i") - 1)
    row = shared_table(plain(scanned(row, n=("next", F.when(F.col("_then").isNull(), F.col("i") + 1)))).select("_g", "i", "s", "e", "n"))
    near = first_reaching(row, row.where(F.col("i") % stride == 0).select("_g", "i", "s", "n", (F.col("s") + least).alias("x")), ["_g"], "e", "x", ["i"]).withColumn("near", F.coalesce(F.col("reached.i") + 1, "n")).drop("x", "reached")
    far = first_reaching(row, near.select("_g", "i", "s", "n", "near", (F.col("s") + most).alias("x")), ["_g"], "e", "x", ["i"], strict=True).withColumn("far", F.coalesce("reached.i", "n"))
    grown = F.least(F.col("n"), F.greatest(F.col("i") + fewest, F.col("near")))
    far = far.withColumn("last", F.least(grown, F.greatest(F.col("far"), F.col("i") + 1))).withColumn("p", F.col("last") - 1).select("_g", "p", "i", "s", "last")
    return far.join(row.select("_g", F.col("i").alias("p"), "e"), ["_g", "p"]).where((F.col("e") - F.col("s")).between(least, most) & (F.col("last") - F.col("i") >= fewest)).select("_g.*", F.col("i").alias("first"), "last")


def _taken(rows: DataFrame, both: Column) -> DataFrame:
    """Rows of ``ordered`` that a greedy walk stops at, which takes two rows at once where ``both`` holds; ``pair`` is then true.

    In a run of rows that could each take the next one, the first, third and so on do, whatever came before the run.
    """
    marked = scanned(rows.withColumn("pair", F.coalesce(both, F.lit(False))), i=("sum", F.lit(1)))
    marked = scanned(marked, _free=("last_before", F.when(~F.col("pair"), F.col("i"))))
    return marked.where((F.col("i") - 1 - F.coalesce("_free", F.lit(0))) % 2 == 0)


def units(words: DataFrame, key: list[str], order: list[str], start: str, end: str, text: str, syllables: str, most: int, shortest: int, longest: int) -> DataFrame:
    """Units (key, start, end, text) of at most ``most`` syllables and of a length within two bounds, from one word or else two neighbours.

    A word that fits is a unit by itself; one that fits with the next one takes it; any other is passed over, as is one
    without syllables.
    """
    at = _ordered(words, key, order, F.col(start).alias("s"), F.col(end).alias("e"), F.col(text).alias("t"), F.col(syllables).alias("n"))
    row = scanned(at, then=("after", F.struct("e", "t", "n")))
    small = F.col("n").between(1, most)
    alone = small & (F.col("e") - F.col("s")).between(shortest, longest)
    both = small & ~alone & (F.col("n") + F.col("then.n") <= most) & (F.col("then.e") - F.col("s")).between(shortest, longest)
    done = plain(_taken(row.withColumn("alone", alone), both).where(F.col("alone") | F.col("pair")))
    return done.select("_g.*", F.col("s").alias("start"), F.when(F.col("pair"), F.col("then.e")).otherwise(F.col("e")).alias("end"), F.when(F.col("pair"), F.concat_ws(" ", "t", "then.t")).otherwise(F.col("t")).alias("text"))


def merged_pairs(details: DataFrame, key: list[str], order: list[str], pairs: dict[tuple[str, str], str], least: bool = False) -> DataFrame:
    """Neighbouring nuclei of one label whose phonemes make one (glide and vowel), merged, each used once.

    ``details`` has label, phoneme, matched, score, position, advice (array) and duration. A merged row has the mean score
    (or the ``least``), both matches and durations together, and at most three different tips.
    """
    columns = ["label", "phoneme", "matched", "score", "position", "advice", "duration"]
    row = scanned(_ordered(details, key, order, *map(F.col, columns)), then=("after", F.struct(*columns)))
    names = F.create_map(*(F.lit(x) for (a, b), whole in pairs.items() for x in (f"{a} {b}", whole)))
    whole = F.try_element_at(names, F.concat_ws(" ", "phoneme", "then.phoneme"))
    both = (F.col("label") == F.col("then.label")) & (F.col("position") == "nucleus") & (F.col("then.position") == "nucleus") & whole.isNotNull()
    done = plain(_taken(row.withColumn("whole", whole), both))
    a, b = F.coalesce("score", F.lit(0.0)), F.coalesce("then.score", F.lit(0.0))
    none = F.array().cast("array<string>")
    joined = {
        "phoneme": F.col("whole"), "score": F.least(a, b) if least else (a + b) / 2, "advice": F.slice(F.array_distinct(F.concat(F.coalesce("advice", none), F.coalesce("then.advice", none))), 1, 3),
        "matched": F.when(F.col("matched").isNotNull() | F.col("then.matched").isNotNull(), F.concat(F.coalesce("matched", F.lit("")), F.coalesce("then.matched", F.lit("")))),
        "duration": F.when(F.col("duration").isNotNull() | F.col("then.duration").isNotNull(), F.coalesce("duration", F.lit(0.0)) + F.coalesce("then.duration", F.lit(0.0))),
    }
    return done.select("_g.*", F.col("i").alias("place"), *(F.when(F.col("pair"), joined[c]).otherwise(F.col(c)).alias(c) if c in joined else F.col(c) for c in columns))


def by_nuclei(phones: DataFrame, expected: DataFrame, key: list[str], order: list[str], vowel: Column, glide: Column) -> DataFrame:
    """Phones with the ``segment`` they fall into, when segment k of ``expected`` (key, segment, n) takes n nuclei.

    A vowel begins a nucleus, with a glide right before it; what follows belongs to it until the next one begins, and phones
    before the first to the first segment that expects any. More nuclei than expected go to the last segment. Segments run
    from 0; keys that expect nothing have no rows.
    """
    at = ordered(phones.withColumn("_v", vowel).withColumn("_g", glide), key, order)
    row = scanned(at, _next=("after", F.col("_v")), _was=("before", F.col("_g")))
    begins = (F.col("_g") & F.coalesce("_next", F.lit(False))) | (F.col("_v") & ~F.coalesce("_was", F.lit(False)))
    row = scanned(row, nucleus=("sum", begins.cast("long"))).withColumn("nucleus", F.greatest(F.col("nucleus"), F.lit(1)))
    wanted = scanned(ordered(expected.select(*key, "segment", F.greatest(F.col("n"), F.lit(0)).alias("n")), key, ["segment"]), upto=("sum", F.col("n")))
    of = wanted.where("n > 0").select("_key", "segment", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("nucleus"))
    last = expected.groupBy(F.struct(*key).alias("_key")).agg(F.max("segment").alias("_last"))
    found = row.join(of, ["_key", "nucleus"], "left").join(last, "_key")
    return plain(found.withColumn("segment", F.coalesce("segment", "_last"))).drop("_v", "_g", "_next", "_was", "_last")
