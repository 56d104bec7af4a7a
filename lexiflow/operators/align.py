"""Sequence alignment and pronunciation scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def similarity(a: str, b: str, soft: dict[tuple[str, str], float], mismatch: float) -> float:
    """1 for equal symbols, the soft value of a pair in either order, else the mismatch (K2)."""
    return 1.0 if a == b else soft.get((a, b), soft.get((b, a), mismatch))


def needleman_wunsch(ref: list[str], hyp: list[str], gap: float = -0.5, mismatch: float = -1.0, soft: dict[tuple[str, str], float] | None = None) -> tuple[list[tuple[int, int]], float]:
    """Pairs (ref, hyp) of a best global alignment, -1 for a gap, and its score; a diagonal step before up before left (K1)."""
    soft = soft or {}
    n, m = len(ref), len(hyp)
    score = [[j * gap for j in range(m + 1)]]
    step = [[2] * (m + 1)]
    for i in range(1, n + 1):
        row, way, above = [i * gap], [1], score[-1]
        for j in range(1, m + 1):
            options = (above[j - 1] + similarity(ref[i - 1], hyp[j - 1], soft, mismatch), above[j] + gap, row[-1] + gap)
            best = max(options)
            row.append(best)
            way.append(options.index(best))
        score.append(row)
        step.append(way)
    pairs, i, j = [], n, m
    while i or j:
        s = step[i][j] if i and j else (1 if i else 2)
        i, j = (i - (s != 2), j - (s != 1))
        pairs.append((i if s != 2 else -1, j if s != 1 else -1))
    return pairs[::-1], score[n][m]


def aligned(gap: float = -0.5, mismatch: float = -1.0, soft: dict[tuple[str, str], float] | None = None):
    """Column function of two arrays of symbols: struct of pairs and score."""

    def on(ref: str | Column, hyp: str | Column) -> Column:
        def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            done = [needleman_wunsch(list(x if x is not None else []), list(y if y is not None else []), gap, mismatch, soft) for x, y in zip(a, b, strict=True)]
            return pd.DataFrame({"pairs": [[{"ri": i, "hj": j} for i, j in p] for p, _ in done], "score": [s for _, s in done]})

        return F.pandas_udf(run, "pairs array<struct<ri:int,hj:int>>, score double")(ref, hyp)

    return on


def normal_score(score: Column, n: Column, m: Column, gap: float = -0.5, mismatch: float = -1.0) -> Column:
    """Score within its best and worst values as 0..1 (K3)."""
    less, apart = F.least(n, m), F.abs(n - m)
    best, worst = less + apart * gap, F.least(less * mismatch + apart * gap, (n + m) * gap)
    return F.when(best == worst, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - worst) / (best - worst))))


def similarity_column(a: Column, b: Column, soft: dict[tuple[str, str], float] | None = None, mismatch: float = -1.0) -> Column:
    """``similarity`` of two columns (K2)."""
    out = F.when(a == b, F.lit(1.0))
    for (x, y), value in (soft or {}).items():
        out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), F.lit(value))
    return out.otherwise(F.lit(mismatch))


def symbol_scores(aligned_rows: DataFrame, row_id: str, ref: str, hyp: str, pairs: str, mismatch: float = -1.0, soft: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """A row for each reference symbol with its partner and their similarity, which may be negative; 0 without a partner (K4, details)."""
    one = aligned_rows.select(row_id, F.col(ref).alias("_r"), F.col(hyp).alias("_h"), F.explode(pairs).alias("p")).where("p.ri >= 0")
    one = one.select(row_id, F.col("p.ri").alias("ri"), F.get("_r", F.col("p.ri")).alias("ref"), F.when(F.col("p.hj") >= 0, F.get("_h", F.col("p.hj"))).alias("hyp"))
    return one.withColumn("score", F.when(F.col("hyp").isNull(), 0.0).otherwise(similarity_column(F.col("ref"), F.col("hyp"), soft, mismatch)))


def _with_words(details: DataFrame, words: DataFrame, row_id: str) -> DataFrame:
    """Symbols with their words; exploded rows are many more than Spark reckons from the files, so neither side is broadcast."""
    return details.join(words.hint("merge"), [row_id, "ri"])


def word_scores(details: DataFrame, words: DataFrame, row_id: str, kind: str = "none", low: float = 0.85) -> DataFrame:
    """Scores by word from ``details`` (row_id, ri, ref, score) and ``words`` (row_id, ri, word_no, label, duration) (K4, by_word).

    ``avg_score`` is plain, ``avg_score_dur`` weighted by the durations, ``low`` the symbols below the limit in order.
    """
    both = _with_words(details, words, row_id)
    listed = F.array_sort(F.collect_list(F.when(F.col("score") < low, F.struct("ri", "ref"))))
    return both.groupBy(row_id, "word_no", "label").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), weighted_mean("score", "duration", kind).alias("avg_score_dur"), F.transform(listed, lambda x: x["ref"]).alias("low"))


def overall_scores(details: DataFrame, words: DataFrame, row_id: str, kind: str = "none") -> DataFrame:
    """Plain and weighted mean over all reference symbols of each row (K4, overall)."""
    return _with_words(details, words, row_id).groupBy(row_id).agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), weighted_mean("score", "duration", kind).alias("avg_score_dur"))


def transferred(pairs: Column, durations: Column, default: float) -> Column:
    """Duration of each reference symbol from its partner."""
    own = F.filter(pairs, lambda p: p["ri"] >= 0)
    return F.transform(own, lambda p: F.coalesce(F.when(p["hj"] >= 0, F.get(durations, p["hj"])), F.lit(default)))


def cer(hyp: Column, ref: Column) -> Column:
    """Edit distance over the reference's length; for an empty reference 1 if anything was said, else 0 (K5)."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) > 0, 1.0).otherwise(0.0)).otherwise(F.levenshtein(hyp, ref) / F.greatest(F.lit(1), F.length(ref)))


def power_mean(value: str, p: float) -> Column:
    """Power mean of values clipped to 0..1."""
    clipped = F.greatest(F.lit(1e-9), F.least(F.lit(1.0), F.col(value)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(F.avg(F.pow(clipped, F.lit(p))), F.lit(1 / p))))


def sentence_score(mean: Column, error: Column, n: Column, weight: float) -> Column:
    """Mean lowered by the error rate, of 100; the weight is at most 0.1 for two symbols or fewer."""
    w = F.when(n <= 2, min(weight, 0.1)).otherwise(weight)
    return mean * (1 - F.least(F.lit(1.0), w * error)) * 100


def syllable_scores(chunks: DataFrame, confidences: DataFrame, row_id: str) -> DataFrame:
    """Mean confidence of each syllable of flat confidences, a silent onset left out.

    ``chunks`` (row_id, chunks: array of label and jamos), ``confidences`` (row_id, place, conf).
    """
    one = chunks.select(row_id, F.posexplode("chunks").alias("chunk", "c")).select(row_id, "chunk", F.col("c.label").alias("label"), F.posexplode("c.jamos").alias("inner", "jamo"))
    flat = one.withColumn("place", F.row_number().over(W.partitionBy(row_id).orderBy("chunk", "inner")) - 1)
    sounded = flat.where(~((F.col("inner") == 0) & (F.col("jamo") == "ㅇ")))
    # Exploded rows are many more than Spark reckons from the files, so it is told not to broadcast them.
    both = sounded.join(confidences.hint("merge"), [row_id, "place"], "left")
    listed = F.array_sort(F.collect_list(F.struct("inner", F.coalesce(F.col("conf").cast("double"), F.lit(0.0)).alias("conf"))))
    return both.groupBy(row_id, "chunk", "label").agg(mean_in_order(F.transform(listed, lambda x: x["conf"])).alias("score"))


def syllable_details(chunks: DataFrame, confidences: DataFrame, row_id: str, tau: float = 1.0) -> DataFrame:
    """Syllables (row_id, chunk, label, conf, score, jamo) with power means of their flat confidences.

    A silent onset is shown as certain and left out of the mean; a syllable of nothing else has 0, as has a missing
    confidence. Confidences beyond the last jamo make one more row, with neither chunk nor label. ``jamo`` lists each jamo
    with its confidence, its score of 100 and whether it is silent; a row's text is one array.
    """
    one = chunks.select(row_id, F.posexplode("chunks").alias("chunk", "c"))
    flat = F.flatten(F.transform(F.col("chunks"), lambda c, i: F.transform(c["jamos"], lambda j, k: F.struct(i.alias("chunk"), c["label"].alias("label"), k.alias("inner"), j.alias("jamo")))))
    placed = chunks.select(row_id, F.posexplode(flat).alias("place", "x")).select(row_id, "place", "x.*")
    both = placed.join(confidences.select(row_id, "place", F.col("conf").cast("double").alias("conf")), [row_id, "place"], "full")
    silent = F.coalesce((F.col("inner") == 0) & (F.col("jamo") == "ㅇ"), F.lit(False))
    both = both.withColumn("silent", silent).withColumn("conf", F.coalesce("conf", F.lit(0.0)))
    clipped = F.greatest(F.lit(1e-9), F.least(F.lit(1.0), F.col("conf")))
    mean = F.pow(F.avg(F.when(~F.col("silent"), F.pow(clipped, F.lit(tau)))), F.lit(1 / tau))
    shown = F.when(F.col("silent"), F.lit(1.0)).otherwise(F.col("conf"))
    whole = lambda x: F.bround(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).cast("int")
    items = F.array_sort(F.collect_list(F.struct("place", F.coalesce("jamo", F.lit("")).alias("jamo"), shown.alias("conf"), whole(shown).alias("score"), "silent")))
    made = both.groupBy(row_id, "chunk", F.coalesce("label", F.lit("")).alias("label")).agg(F.coalesce(mean, F.lit(0.0)).alias("conf"), items.alias("jamo"))
    empty = one.where(F.size("c.jamos") == 0).select(row_id, "chunk", F.col("c.label").alias("label"), F.lit(0.0).alias("conf"), F.array().cast(made.schema["jamo"].dataType).alias("jamo"))
    made = made.unionByName(empty)
    return made.select(row_id, "chunk", "label", "conf", whole(F.col("conf")).alias("score"), "jamo")


def missing_ratio(conf: str, threshold: float) -> Column:
    """Share of low confidences, 1 without any."""
    return F.coalesce(F.avg(F.when(F.col(conf) < threshold, 1.0).otherwise(0.0)), F.lit(1.0))


def weighted_mean(score: str, duration: str, kind: str = "none") -> Column:
    """Mean weighted by 1, the duration, its root or its log; without a duration the weight is 0."""
    d = F.col(duration)
    w = {"none": F.lit(1.0), "linear": d, "sqrt": F.sqrt(d), "log1p": F.log1p(d)}[kind]
    w = F.when(d.isNull() & F.lit(kind != "none"), 0.0).otherwise(w)
    return F.when(F.sum(w) > 0, F.sum(F.col(score) * w) / F.sum(w)).otherwise(0.0)


def frame_confidence(p: str) -> Column:
    """Mean of the values above 0.1, of all if there are none."""
    return F.coalesce(F.avg(F.when(F.col(p) > 0.1, F.col(p))), F.avg(p))


def mean_in_order(values: Column) -> Column:
    """Mean of an array's values, added up in its order, so that no rounding hangs on how rows are dealt; nulls are passed over."""
    some = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))


def frame_confidence_in_order(p: Column) -> Column:
    """``frame_confidence`` of an array in its order."""
    return F.coalesce(mean_in_order(F.filter(p, lambda x: x > 0.1)), mean_in_order(p))


def greedy_decode(frames: DataFrame, key: list[str], order: str, label: str, p: str, blank: str, threshold: float, release: float | None = None, keep_blank: bool = True) -> DataFrame:
    """Best labels of frames as a text: repeats collapse, blanks go (K7; the label of a frame is given).

    A frame below ``threshold`` is blank. With ``release`` (hysteresis) a label that has been heard goes on while the
    same label stays at or above it. Without ``keep_blank`` blank frames are left out before repeats collapse.
    """
    from .intervals import runs

    shown = F.when(F.col(p) >= threshold, F.col(label)).otherwise(blank)
    if release is not None:
        # A stretch of one label at or above the lower limit is heard from its first frame at the upper one on.
        w = W.partitionBy(*key).orderBy(order)
        held = frames.withColumn("_h", F.when(F.col(p) >= release, F.col(label)).otherwise(blank))
        held = held.withColumn("_s", F.sum(F.when(F.col("_h").eqNullSafe(F.lag("_h").over(w)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
        heard = F.max(F.when(F.col(p) >= threshold, 1).otherwise(0)).over(W.partitionBy(*key, "_s").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
        frames, shown = held.withColumn("_heard", heard), F.when(F.col("_heard") == 1, F.col("_h")).otherwise(blank)
    frames = frames.withColumn("_l", shown)
    one = runs(frames if keep_blank else frames.where(F.col("_l") != blank), key, [order], "_l").where(F.col("_l") != blank)
    return one.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "_l"))), lambda x: x["_l"]), "").alias("decoded"))


def speech_crop(frames: DataFrame, key: list[str], place: str, blank_p: str, threshold: float, pad: int) -> DataFrame:
    """First and last frame that is no blank, padded (K8)."""
    spoken = F.when(F.col(blank_p) < threshold, F.col(place))
    return frames.groupBy(*key).agg(F.greatest(F.lit(0), F.min(spoken) - pad).alias("first_frame"), F.least(F.max(place), F.max(spoken) + pad).alias("last_frame"))


def gate(ref_len: Column, cer_: Column, skeleton: Column, nlp: Column, ref_nll: Column, mean_forced: Column, max_forced: Column, mismatch: Column, cer_limit: float = 0.35, loss_limit: float = 2.5, nll_limit: float = 2.0, short_bonus: float = 0.05, mean_limit: float = 0.4, max_limit: float = 0.7) -> Column:
    """Whether metrics of one utterance pass: by pair, likelihood, short form or forced confidence."""
    n = F.greatest(F.lit(1), F.floor(ref_len / 3))
    bonus = F.when(n <= 2, 0.10).when(n <= 5, short_bonus).otherwise(0.0)
    pair = (cer_ < cer_limit + bonus) & (nlp < loss_limit)
    likely = ref_nll < nll_limit + F.when(n <= 2, 0.3).otherwise(0.0)
    short = (n <= 2) & (skeleton < 0.6) & ~mismatch
    forced = (n <= 2) & (mean_forced >= mean_limit) & (max_forced >= max_limit) & ~mismatch & ((cer_ < 0.45) | (skeleton < 0.45))
    return pair | likely | short | forced


def advice(rows: DataFrame, rules: DataFrame, key: list[str], symbol: str, limit: int = 3, vowels: tuple[str, ...] = (), most: int = 1_000) -> DataFrame:
    """At most ``limit`` distinct tips for the low symbols of each key, in their order.

    ``rules`` (rule_idx, tip and any of the conditions covers, prev_in, next_in, class_in, rule_position, rule_env,
    next_is_vowel, pair_a with pair_b) has at most ``most`` rows (more are an error) and is broadcast as one array; a condition that is
    null or no column always holds (J4). ``rows`` has place, and of prev, next, class, position and env what rules ask for. A
    pair holds where one of its sets has the symbol and the other the next one, either way round.
    """
    n = rules.count()
    if n > most:
        raise ValueError(f"{n} rules, {most} are allowed")
    conditions = {
        "covers": lambda r: F.array_contains(r["covers"], F.col(symbol)),
        "prev_in": lambda r: F.array_contains(r["prev_in"], F.col("prev")),
        "next_in": lambda r: F.array_contains(r["next_in"], F.col("next")),
        "class_in": lambda r: F.array_contains(r["class_in"], F.col("class")),
        "rule_position": lambda r: r["rule_position"] == F.col("position"),
        "rule_env": lambda r: r["rule_env"] == F.col("env"),
        "next_is_vowel": lambda r: ~r["next_is_vowel"] | F.col("next").isin(*vowels),
        "pair_a": lambda r: (F.array_contains(r["pair_a"], F.col(symbol)) & F.array_contains(r["pair_b"], F.col("next"))) | (F.array_contains(r["pair_b"], F.col(symbol)) & F.array_contains(r["pair_a"], F.col("next"))),
    }

    def holds(r: Column) -> Column:
        out = F.lit(True)
        for name, condition in conditions.items():
            if name in rules.columns:
                out &= r[name].isNull() | condition(r)
        return out

    listed_rules = rules.agg(F.collect_list(F.struct(*rules.columns)).alias("_rules"))
    met = rows.join(F.broadcast(listed_rules)).select(*key, "place", F.explode(F.filter("_rules", holds)).alias("_r")).select(*key, "place", "_r.tip", "_r.rule_idx")  # one row
    # A tip's first place is combined before the shuffle, so a key has no more rows than there are tips.
    first = met.groupBy(*key, "tip").agg(F.min(F.struct("place", "rule_idx")).alias("at"))
    listed = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "tip"))).alias("t"))
    return listed.select(*key, F.slice(F.transform("t", lambda x: x["tip"]), 1, limit).alias("tips"))
