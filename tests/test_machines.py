"""State machines over ranges of keys against one walk over each key's rows."""

import random
from collections import defaultdict
from functools import partial

import pytest

from lexiflow.operators import machines, state


@pytest.fixture(scope="module")
def ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(r, n):
    """Half of all rows have one key; long stretches of one text and of one kind of frame."""
    out, at = [], 0
    for i in range(n):
        at += r.randrange(30)
        text = " ".join(r.choice("abcd") for _ in range(5)) if r.random() < 0.3 else "a b c d e"
        out.append((r.choice(["hot", "hot", "x", "y", None]), i, at, at + 20, r.random() < 0.85 if i % 200 < 120 else r.random() < 0.2, r.choice([None, ""]) if r.random() < 0.02 else text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_machines_equal_one_walk(ranges, seed):
    rows = rows_of(random.Random(seed), 500)
    df = ranges.createDataFrame(rows, "k string, i long, s long, e long, flag boolean, text string")
    by_key = defaultdict(list)
    for k, *x in rows:
        by_key[k].append(x)
    for machine, columns, outputs, whole in (
        (partial(machines.UnlikeLastKept, 0.7), ["i", "text"], ["kept"], lambda v: state.unlike_last_kept([(x[0], x[4]) for x in v], 0.7)),
        (partial(machines.Hysteresis, start_ms=30, end_ms=40, pad_ms=5, least_ms=45), ["flag"], ["a", "b"], lambda v: state.hysteresis([(x[3],) for x in v], start_ms=30, end_ms=40, pad_ms=5, least_ms=45)),
        (partial(machines.Packs, 300, 40, 120), ["s", "e", "flag"], ["a", "b"], lambda v: state.pack_to_target([tuple(x[1:4]) for x in v], 300, 40, 120)),
    ):
        got = defaultdict(list)
        for r in machines.machine_over_keys(df, ["k"], ["i"], machine, columns, outputs).collect():
            got[r["k"]].append(tuple(r[o] for o in outputs))
        want = {k: sorted(map(tuple, whole(v))) for k, v in by_key.items()}
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
        assert sum(map(len, want.values())) > 5


class Parity(machines.Machine):
    """A machine that never forgets: every range must be repaired, one after the other."""

    state = 0

    def feed(self, i):
        self.state += 1
        if self.state % 2 == 0:
            yield (i,)


def test_machine_that_never_forgets(ranges):
    df = ranges.range(201).selectExpr("1 AS k", "id AS i")
    got = sorted(r["n"] for r in machines.machine_over_keys(df, ["k"], ["i"], Parity, ["i"], ["n"]).collect())
    assert got == list(range(1, 201, 2))


def test_machine_over_nothing(ranges):
    none = ranges.createDataFrame([], "k string, i long, flag boolean")
    assert machines.machine_over_keys(none, ["k"], ["i"], machines.Hysteresis, ["flag"], ["a", "b"]).collect() == []
