"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

The sketch has ``bands * rows`` coordinates. In round ``i`` every shingle of a set falls into one hashed coordinate with
a value above all values of earlier rounds; round ``t + j`` puts all shingles into coordinate ``j``, so that every
coordinate fills. Two sets agree in a coordinate with the probability of their Jaccard similarity, with the
concentration of independent draws, in a handful of rounds instead of one for each coordinate.

Documents whose shingle sets are equal form a class, represented by its smallest doc_id. Representatives meet in band
buckets. A bucket first compares its members with one of them, the one that meets most others. Buckets that still hold
members of different components go through rounds of stars: those outside the bucket's largest component are compared
with a member of it and with one of their own, other ones in every bucket and round, so that a member with many links is
soon joined through one of them. What stays apart is compared by an exact set-similarity join: two sets similar enough
share one of their rarest shingles at places that leave room for the rest of the overlap. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, discard, join_counted, materialise, mix, text_bytes
from .components import components

#: Bands and coordinates in each: two sets of similarity 0.8 share no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: Of the sketch's first 128 one-bit coordinates, a pair of similarity 0.8 differs in 12.8 on average (deviation 3.4); more
#: than this many is 6 deviations off, and such pairs are left out of the stars. The join after them doesn't look at it.
MAX_BITS = 34
#: Rounds of stars go on while they join at least this share of the components left, and for at most so many.
WORTHWHILE, MAX_STARS = 0.1, 6

_BYTE = mix(np.arange(256, dtype=np.uint64), 77)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of ``size`` words of each text (ascending), and their offsets.

    Words are runs of bytes but ASCII white space, A-Z lower-cased. Fewer words than ``size`` make one shingle; no
    words, no shingle.
    """
    docs, n = len(offsets) - 1, len(data)
    low = _LOWER[data]
    inside = ~_SPACE[low]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    word = np.cumsum(start) - 1
    place = np.arange(n) - starts[np.maximum(word, 0)]
    value = _BYTE[low] * _powers(int(place.max()) + 1)[np.maximum(place, 0)]
    value[~inside] = 0
    words = mix(np.add.reduceat(value, starts), 1)
    cut = np.searchsorted(starts, offsets)
    sets, ends = [], np.zeros(docs + 1, np.int64)
    run = words.copy()
    for j in range(1, size):
        run[:-j] = mix(run[:-j], 2) + words[j:] if j < len(words) else run[:-j]
    for d in range(docs):
        lo, hi = cut[d], cut[d + 1]
        if hi - lo >= size:
            one = np.unique(run[lo : hi - size + 1])
        elif hi > lo:
            one = words[lo : lo + 1].copy()
            for w in words[lo + 1 : hi]:
                one = mix(one, 3) + w
            one = mix(one, 4 + int(hi - lo))
        else:
            one = words[:0]
        sets.append(one)
        ends[d + 1] = ends[d] + len(one)
    return np.concatenate(sets), ends


def sketches(values: np.ndarray, ends: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of each set, ``t`` uint64 coordinates; an empty set keeps the largest value everywhere."""
    docs = len(ends) - 1
    out = np.full(docs * t, np.uint64(0xFFFFFFFFFFFFFFFF))
    size = np.diff(ends)
    doc, open_ = np.repeat(np.arange(docs), size), size > 0
    for i in range(2 * t):
        if not open_.any():
            break
        keep = open_[doc]
        if not keep.all():
            doc, values = doc[keep], values[keep]
        h = mix(values, 100 + i)
        at = (h & np.uint64(0xFFFFFFFF)) % np.uint64(t) if i < t else np.uint64(i - t)
        v = (h >> np.uint64(10)) | np.uint64(i << 54)
        np.minimum.at(out, doc * t + at.astype(np.int64), v)
        open_ &= (out.reshape(docs, t) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
    return out.reshape(docs, t)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch_batches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch["text"]):
                values, ends = shingle_sets(data, offsets, size)
                n, full = np.diff(ends), np.append(values, np.uint64(0))
                # sums over each set; reduceat needs care for empty ones
                total = [np.where(n > 0, np.add.reduceat(mix(full, s), np.minimum(ends[:-1], len(values))), np.uint64(0)) for s in (5, 6)]
                total = [x if len(values) else np.zeros(hi - lo, np.uint64) for x in total]
                last = [mix(x, 7) for x in total]
                s = sketches(values, ends, bands * rows)
                keys = np.zeros((hi - lo, bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys, 8) + s[:, r::rows][:, :bands]
                keys = mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), 9)
                bit = (mix(s[:, :128], 10) >> np.uint64(63)).astype(np.uint64)
                bits = (bit.reshape(hi - lo, 2, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][lo:hi], pa.array(n), pa.array(_signed(last[0])), pa.array(_signed(last[1])), pa.array(_signed(bits[:, 0].copy())), pa.array(_signed(bits[:, 1].copy())), pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(_signed(keys.ravel())))],
                    ["doc_id", "n_shingles", "s1", "s2", "b1", "b2", "bands"],
                )

    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch["text"]):
                values, ends = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_signed(values)))], ["doc_id", "shingles"])

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the full shingle sets x of a and y of b."""
    return pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with the sizes of their sets (na, nb) and of the intersection (common)."""
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return _with_sets(pairs, sets).select("a", "b", F.size("x").cast("long").alias("na"), F.size("y").cast("long").alias("nb"), common.alias("common"))


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _alike(percent: int):
    """Pairs that sizes and one-bit coordinates leave possible, for sides p and q with columns n, b1 and b2."""
    bits = F.bit_count(F.col("p.b1").bitwiseXOR(F.col("q.b1"))) + F.bit_count(F.col("p.b2").bitwiseXOR(F.col("q.b2")))
    return (100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")) & (bits <= MAX_BITS)


def _mixed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Members (with their ``component`` and the bucket's largest one, ``main``) of the buckets that hold several components."""
    rows = shared.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = rows.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("parts"))
    return rows.join(parts.where("parts > 1").select("key", F.col("m.component").alias("main")), "key")


def _stars(mixed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a member outside its bucket's largest component and one of two leads: a member of that component, and one outside."""
    pick = F.min(F.struct(F.xxhash64(F.lit(turn), "key", "id").alias("h"), "id", "component", "n", "b1", "b2"))
    leads = mixed.groupBy("key", (F.col("component") == F.col("main")).alias("inside")).agg(pick.alias("q")).select("key", "q")
    odd = mixed.where("component <> main").select("key", F.struct("id", "component", "n", "b1", "b2").alias("p"))
    return odd.join(leads, "key").where((F.col("p.component") != F.col("q.component")) & _alike(percent)).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()


def _joined(found: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """``found`` with the components that ``links`` connect as one, and how many went into others."""
    if links.isEmpty():
        return found, 0
    part = found.select(F.col("id"), F.col("component"))
    ends = links
    for side in ("a", "b"):
        ends = ends.join(part.select(F.col("id").alias(side), F.col("component").alias(f"{side}_in")), side, "left").withColumn(side, F.coalesce(f"{side}_in", side)).drop(f"{side}_in")
    more = components(ends.distinct())
    merged = more.count()
    into = more.select(F.col("id").alias("component"), F.col("component").alias("into"))
    moved = found.join(into, "component", "left").select("id", F.coalesce("into", "component").alias("component"))
    now = materialise(moved.union(more.join(found, "id", "left_anti").select("id", "component")))
    discard(more, found)
    return now, merged


def _close(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``rest`` (id, component, shingles) in different components that sizes and rare shingles leave possible.

    Shingles are ordered by their number of sets, rarest first. Sets of sizes n and m that are similar enough have an
    overlap of at least percent / (100 + percent) * (n + m), so the first shingle they share stands where so many are
    still to come in both, which is within the first ``n - ceil(percent * n / 100) + 1``. Shingles of one set meet nothing
    and need no row, only their places.
    """
    one = rest.select("id", F.explode("shingles").alias("shingle"))
    often = one.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    lists = one.join(often, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "shingle"))).alias("often"))
    sized = rest.select("id", "component", F.size("shingles").alias("n")).join(lists, "id")
    need = F.ceil(percent * F.col("n") / 100).cast("int")
    first = sized.withColumn("k", F.size("often") - need + 1).where("k > 0").select("id", "component", "n", (F.col("n") - F.size("often")).alias("alone"), F.posexplode(F.slice("often", 1, F.col("k"))).alias("place", "x"))
    first = materialise(first.select("id", "component", F.col("n").cast("long").alias("n"), (F.col("n") - F.col("alone") - F.col("place")).cast("long").alias("left"), F.col("x.shingle").alias("shingle")))  # left: it and those after it
    fits = (100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")) & ((100 + percent) * F.least("p.left", "q.left") >= percent * (F.col("p.n") + F.col("q.n")))
    met = first.alias("p").join(first.alias("q"), (F.col("p.shingle") == F.col("q.shingle")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.component") != F.col("q.component")) & fits)
    pairs = materialise(met.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct())
    discard(first)
    return pairs


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row of ``docs`` (doc_id, text; other columns are ignored).

    Links documents whose sets of ``size``-word shingles have ``100 * intersection >= percent * union``. Null, empty and
    blank texts have no shingles and no links. Repeated rows give a result row each; equal doc_ids with different
    texts count as linked through their id and the row with the smallest set stands for them when pairs are verified.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sketched = materialise(
        docs.select("doc_id", text_bytes().alias("text")).mapInArrow(_sketch_batches(size, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, b1 long, b2 long, bands array<long>")
    )
    key = ["s1", "s2", "n_shingles"]
    classes = materialise(sketched.where("n_shingles > 0").groupBy(key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")))

    one = sketched.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi")
    rows_ = one.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "b1", "b2")
    buckets = rows_.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", "c")
    shared = materialise(rows_.join(buckets, "key"))
    ids = shared.select(F.col("id").alias("doc_id")).distinct()
    sets = docs.join(ids, "doc_id", "left_semi").select("doc_id", text_bytes().alias("text")).mapInArrow(_set_batches(size), "doc_id long, shingles array<long>")
    sets = materialise(sets.groupBy("doc_id").agg(F.min("shingles").alias("shingles")))

    # A bucket's first partner for all: the member that meets most others, as near the middle of its group as any.
    score = shared.groupBy("id").agg(F.sum("c").alias("score"))
    leads = shared.join(score, "id").groupBy("key").agg(F.max(F.struct("score", "id", "n", "b1", "b2")).alias("q"))
    star = shared.select("key", F.struct("id", "n", "b1", "b2").alias("p")).join(leads, "key").where((F.col("p.id") != F.col("q.id")) & _alike(percent))
    star = star.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    found = components(_linked(_compared(star, sets), percent))

    for turn in range(MAX_STARS):
        mixed = materialise(_mixed(shared, found))
        links = materialise(_linked(_compared(_stars(mixed, turn, percent), sets), percent))
        left = mixed.where("component <> main").agg(F.count_distinct("component")).first()[0]
        found, merged = _joined(found, links)
        discard(mixed, links)
        if merged <= WORTHWHILE * left:
            break

    apart = _mixed(shared, found).select(F.col("id").alias("doc_id"), "component").distinct()
    rest = materialise(apart.join(sets, "doc_id").withColumnRenamed("doc_id", "id"))
    pairs = _close(rest, percent)
    links = materialise(_linked(_compared(pairs, sets), percent))
    found, _ = _joined(found, links)
    discard(shared, sets, rest, pairs, links)
    named = classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*key, "c", F.coalesce("component", "rep").alias("component_id"))
    rows_ = sketched.select("doc_id", *key)
    full = join_counted(rows_.where("n_shingles > 0"), named, key, rows_.count()).select("doc_id", "n_shingles", "component_id")
    out = full.union(rows_.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
