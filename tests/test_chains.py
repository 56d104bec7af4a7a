"""Scans and greedy chains over random rows against plain loops, with one key in many ranges."""

import random
from collections import defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import chains, scans, state


@pytest.fixture(scope="module")
def wide(spark):
    """Many small ranges, as on a cluster."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def keyed(rows):
    out = defaultdict(list)
    for k, *rest in rows:
        out[k].append(tuple(rest))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}


def test_scans_equal_loops(wide):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None, "c"]), i, r.choice([None, r.randrange(50)])) for i in range(400)]
    r.shuffle(rows)
    kinds = ("sum", "max", "max_before", "min", "last", "last_before", "next", "before", "after")
    df = wide.createDataFrame(rows, "k string, i int, v int")
    held = scans.ordered(df, ["k"], ["i"])
    assert held.where("k = 'a'").select("_part").distinct().count() > 2
    got = scans.plain(scans.scanned(held, **{x: (x, F.col("v")) for x in kinds})).collect()
    assert len(got) == len(rows)
    by_key = keyed(rows)
    for x in got:
        seq = by_key[x["k"]]
        at = [i for i, _ in seq].index(x["i"])
        values = [v for _, v in seq]
        upto, past, ahead = ([v for v in part if v is not None] for part in (values[: at + 1], values[:at], values[at:]))
        want = {
            "sum": sum(upto) if upto else None, "max": max(upto, default=None), "max_before": max(past, default=None), "min": min(upto, default=None), "last": upto[-1] if upto else None,
            "last_before": past[-1] if past else None, "next": ahead[0] if ahead else None, "before": values[at - 1] if at else None, "after": values[at + 1] if at + 1 < len(values) else None,
        }
        assert {k: x[k] for k in kinds} == want


def test_no_range_holds_a_hot_key(wide):
    rows = wide.range(20_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    done = scans.scanned(scans.ordered(rows, ["k"], ["id"]), n=("sum", F.lit(1)))
    sizes = [x["count"] for x in done.groupBy("_part").count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    assert done.where("k = 1").agg(F.max("n")).first()[0] == 10_001


def intervals(r, n, most_gap=40):
    at, out = 0, []
    for i in range(n):
        at += r.choice([0, 5, r.randrange(most_gap)])
        end = at + r.randrange(5, 90)
        out.append((i, at, end))
        at = end
    return out


def by_key(got, *columns):
    out = defaultdict(list)
    for x in got:
        out[x["k"]].append(tuple(x[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_packs_equal_state_machine(wide):
    r = random.Random(3)
    keys = ["a", "b", None, "one", "quiet"]
    rows = {k: [(i, s, e, r.random() < 0.1 or k == "quiet") for i, s, e in intervals(r, {"a": 300, "one": 1}.get(k, 25))] for k in keys}
    words = {"a": [(s, s + r.randrange(200, 900)) for s in range(150, 12_000, 400)], "b": [(400, 900)]}
    df = wide.createDataFrame([(k, *x) for k, v in rows.items() for x in v], "k string, i long, s long, e long, silent boolean")
    word = wide.createDataFrame([(k, a, b) for k, v in words.items() for a, b in v], "k string, start long, end long")
    limited = chains.word_limits(df, word, ["k"], "s")
    for target, least, most in ((200, 30, 150), (50, 0, 400)):
        for some, given, limit in ((df, {}, None), (limited, words, "limit")):
            got = by_key(chains.packs(some, ["k"], ["i"], "s", "e", "silent", target, least, most, limit).collect(), "start", "end")
            want = {k: sorted(state.pack_to_target([x[1:] for x in v], target, least, most, given.get(k, ()))) for k, v in rows.items()}
            assert got == {k: v for k, v in want.items() if v}


def test_splices_and_groups_equal_loops(wide):
    r = random.Random(4)
    rows = {k: [(i, s, e, r.choice("aeptk")) for i, s, e in intervals(r, n, 12)] for k, n in (("a", 240), ("b", 9), (None, 30), ("one", 1))}
    df = wide.createDataFrame([(k, *x) for k, v in rows.items() for x in v], "k string, i long, s long, e long, l string")
    vowel = lambda x: x in "ae"
    for least, most in ((100, 300), (500, 60)):
        got = by_key(chains.spliced(df, ["k"], ["i"], "s", "e", F.col("l").isin("a", "e"), least, most).collect(), "first", "last")
        assert got == {k: sorted(state.splice([x[1:] for x in v], least, most, vowel)) for k, v in rows.items()}
    for least, most, fewest, stride in ((100, 300, 2, 1), (50, 400, 4, 3)):
        got = by_key(chains.groups_from_each(df, ["k"], ["i"], "s", "e", least, most, fewest, stride).collect(), "first", "last")
        want = {k: sorted(state.phone_groups([x[1:3] for x in v], least, most, fewest, stride)) for k, v in rows.items()}
        assert got == {k: v for k, v in want.items() if v}


def test_units_equal_loop(wide):
    r = random.Random(5)
    rows = {k: [(i, s, e, f"w{i}", r.randrange(4)) for i, s, e in intervals(r, n)] for k, n in (("a", 300), ("b", 8), (None, 20))}
    df = wide.createDataFrame([(k, *x) for k, v in rows.items() for x in v], "k string, i long, s long, e long, t string, n long")
    for shortest, longest in ((60, 200),):
        want = {}
        for k, words in rows.items():
            i, out = 0, []
            while i < len(words):
                _, s, e, t, n = words[i]
                step = 1
                if 1 <= n <= 2:
                    if shortest <= e - s <= longest:
                        out.append((s, e, t))
                    elif i + 1 < len(words) and n + words[i + 1][4] <= 2 and shortest <= words[i + 1][2] - s <= longest:
                        out.append((s, words[i + 1][2], f"{t} {words[i + 1][3]}"))
                        step = 2
                i += step
            want[k] = sorted(out)
        assert by_key(chains.units(df, ["k"], ["i"], "s", "e", "t", "n", 2, shortest, longest).collect(), "start", "end", "text") == {k: v for k, v in want.items() if v}
        assert any(" " in x[2] for v in want.values() for x in v)


def test_pairs_are_used_once(wide):
    r = random.Random(6)
    pairs = {("w", "a"): "wa", ("a", "w"): "aw", ("j", "a"): "ja"}
    rows = {k: [(i, r.choice("xy") if i % 7 == 0 else "x", r.choice("waj"), r.choice([None, "m"]), r.choice([None, 0.25, 0.5]), r.choice(["nucleus"] * 5 + ["coda"]), r.choice([None, ["t"], ["t", "u"], ["v", "z"]]), r.choice([None, 2.0])) for i in range(n)] for k, n in (("a", 260), ("b", 1), (None, 15))}
    df = wide.createDataFrame([(k, *x) for k, v in rows.items() for x in v], "k string, i long, label string, phoneme string, matched string, score double, position string, advice array<string>, duration double")
    for least in (False, True):
        want = {}
        for k, v in rows.items():
            out, i = [], 0
            while i < len(v):
                a, b = v[i], v[i + 1] if i + 1 < len(v) else None
                whole = pairs.get((a[2], b[2])) if b and a[1] == b[1] and a[5] == b[5] == "nucleus" else None
                if whole:
                    x, y = a[4] or 0.0, b[4] or 0.0
                    tips = list(dict.fromkeys((a[6] or []) + (b[6] or [])))[:3]
                    out.append((i + 1, whole, (a[3] or "") + (b[3] or "") if a[3] is not None or b[3] is not None else None, min(x, y) if least else (x + y) / 2, tips, (a[7] or 0) + (b[7] or 0) if a[7] is not None or b[7] is not None else None))
                else:
                    out.append((i + 1, a[2], a[3], a[4], a[6], a[7]))
                i += 2 if whole else 1
            want[k] = out
        got = by_key(chains.merged_pairs(df, ["k"], ["i"], pairs, least).collect(), "place", "phoneme", "matched", "score", "advice", "duration")
        assert got == want


def test_nuclei_equal_loop(wide):
    r = random.Random(7)
    rows = {k: [(i, r.choice("aeptkj")) for i in range(n)] for k, n in (("a", 300), ("b", 12), (None, 9), ("c", 4))}
    wanted = {"a": [r.choice([0, 1, 1, 2]) for _ in range(60)], "b": [0, 1, 0, 3], None: [1], "c": [0, 0]}
    vowel = lambda x: x in "ae"
    want = {}
    for k, v in rows.items():
        seq, segments, i = [x for _, x in v], [], 0
        for exp in wanted[k]:
            part, n = [], 0
            while exp > 0 and i < len(seq):
                part.append(i)
                n += vowel(seq[i])
                i += 1
                if n >= exp and i < len(seq) and (vowel(seq[i]) or seq[i] == "j" and i + 1 < len(seq) and vowel(seq[i + 1])):
                    break
            segments.append(part)
        segments[-1] += range(i, len(seq))
        want[k] = sorted((x, n) for n, part in enumerate(segments) for x in part)
    df = wide.createDataFrame([(k, *x) for k, v in rows.items() for x in v], "k string, i long, l string")
    expected = wide.createDataFrame([(k, i, n) for k, v in wanted.items() for i, n in enumerate(v)], "k string, segment long, n long")
    got = by_key(chains.by_nuclei(df, expected, ["k"], ["i"], F.col("l").isin("a", "e"), F.col("l") == "j").collect(), "i", "segment")
    assert got == want


def test_chains_of_nothing(wide):
    none = wide.createDataFrame([], "k string, i long, s long, e long, silent boolean, l string")
    assert chains.packs(none, ["k"], ["i"], "s", "e", "silent", 5, 1, 9).collect() == []
    assert chains.spliced(none, ["k"], ["i"], "s", "e", F.col("l") == "a", 1, 5).collect() == []


def test_long_chain_in_few_rounds(wide):
    """Every third place of one key: as many rounds as its length has bits."""
    n = 600
    steps = wide.range(n).select(F.struct(F.lit(1).alias("k")).alias("_g"), F.col("id").alias("i"), F.when(F.col("id") + 3 < n, F.col("id") + 3).alias("to"), (F.col("id") == 1).alias("first"))
    assert sorted(x["i"] for x in chains.reached(steps).collect()) == list(accumulate([1, *[3] * (n // 3 - 1)]))
