"""Forced paths and monotonic alignments against all paths there are."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lexiflow.operators import trellis


def all_paths(n, states):
    """Paths over states that begin in the first two, stay or go on by one, and end in the last two."""
    for first in range(min(2, states)):
        for moves in itertools.product((0, 1), repeat=n - 1):
            path = list(itertools.accumulate((first, *moves)))
            if path[-1] in (states - 1, states - 2):
                yield path


def test_forced_paths_equal_enumeration():
    r = np.random.default_rng(5)
    batch = []
    for _ in range(60):
        labels = r.integers(1, 5, r.integers(1, 4)).tolist()
        n = int(r.integers(max(1, 2 * len(labels) - 1), 9))
        batch.append((-r.integers(0, 40, (n, 5)) / 8.0, labels))
    for (e, labels), path in zip(batch, trellis.forced_paths(batch, 0), strict=True):
        s = trellis.extended(labels, 0)
        score = lambda p: sum(e[t, s[m]] for t, m in enumerate(p))  # noqa: B023, E731
        assert list(path) in list(all_paths(len(e), len(s)))
        assert score(path) == max(score(p) for p in all_paths(len(e), len(s)))


def test_confidence_by_hand():
    e = np.log(np.array([[0.1, 0.6, 0.3], [0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.05, 0.9, 0.05]]))
    assert math.isclose(trellis.confidence(e, 1, 0, [], trellis.Role()), np.mean([0.6 / 0.7, 0.7 / 0.9, 0.9 / 0.95]))  # the frame that the blank leads is left out
    sig = lambda m: 1 / (1 + math.exp(-m / 0.25))
    margins = [math.log(0.6 / 0.3), math.log(0.7 / 0.1), math.log(0.9 / 0.05)]
    assert math.isclose(trellis.confidence(e, 1, 0, [2], trellis.Role()), ((np.mean([sig(m) for m in margins]) - 0.05) / 0.95) ** 0.9)
    assert math.isclose(trellis.confidence(e, 1, 0, [2], trellis.Role(tail=0.75, bias=0, power=1)), sig(margins[2]))
    assert math.isclose(trellis.confidence(e, 1, 0, [2], trellis.Role(top=0.3, bias=0, power=1)), sig(margins[2]))
    assert math.isclose(trellis.confidence(e, 1, 0, [2], trellis.Role(pool=0.34, bias=0, power=1)), (sig(margins[2]) + sig(margins[1])) / 2)
    assert trellis.confidence(e, 2, 0, [1], trellis.Role(floor=0.3)) == 0.3


def test_units_without_frames_and_odd_rows(spark):
    e = [[-1.0, -0.5, -3.0], [-1.0, -2.0, -0.25]]
    frames = spark.createDataFrame([(1, 1, e[1]), (1, 0, e[0]), (2, 0, e[0]), (None, 0, e[0]), (3, 0, e[0])], "u int, t int, e array<double>")
    refs = spark.createDataFrame([(1, [1, 2, 1], None), (2, [], None), (4, [1], None), (3, [2], ["v"]), (None, [1], None)], "u int, labels array<int>, roles array<string>")
    got = {(r.u, r.unit): (r.label, r.first_frame, r.last_frame, r.n_frames) for r in trellis.forced_confidences(frames, refs, ["u"], 0, {1: "a", 2: "a"}, {"v": trellis.Role(floor=1.0)}).collect()}
    # Two frames can't reach the last of seven states; what isn't on the path is judged by its best frame. A null key is a key.
    assert got == {(1, 0): (1, 0, 0, 0), (1, 1): (2, 1, 1, 0), (1, 2): (1, 0, 0, 0), (3, 0): (2, 0, 0, 1), (None, 0): (1, 0, 0, 1)}
    assert trellis.forced_confidences(frames.where("false"), refs, ["u"], 0, {}).collect() == []


def test_monotonic_paths_equal_enumeration(spark):
    r = random.Random(2)
    data = [(i, [[r.randrange(40) / 4 for _ in range(w)] for _ in range(h)]) for i, (h, w) in enumerate([(6, 6), (6, 3), (6, 1), (1, 1), (5, 4), (6, 2), (6, 5)] * 3)]
    data += [(100, [[1.0, 2.0]]), (101, []), (102, None)]
    df = spark.createDataFrame(data, "i int, m array<array<double>>")
    for i, m, path in df.select("i", "m", trellis.monotonic_path(F.col("m")).alias("p")).collect():
        if i >= 100:
            assert path is None
            continue
        h, w = len(m), len(m[0])
        every = [p for moves in itertools.product((0, 1), repeat=h - 1) if (p := list(itertools.accumulate((0, *moves))))[-1] == w - 1]
        score = lambda p: sum(m[y][x] for y, x in enumerate(p))  # noqa: B023, E731
        assert path in every and score(path) == max(map(score, every))
