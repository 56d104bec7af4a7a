"""Centroid clustering: trees, rounds and odd rows against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import lloyd


def brute(rows, k, rounds, size):
    """Lloyd in plain integers over (vec_id, components)."""
    kept = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), p) for i, p in kept if i is not None)[:k]
    at = [p for _, p in first]
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
    near = lambda p: min((far(p, c), n) for n, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(near(p)[1], []).append(p)
        for c, g in groups.items():
            at[c] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = [(i, *near(p)) for i, p in kept]
    inertia = [sum(d for _, d, c in found if c == n) for n in range(len(at))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, inertia[c], sum(inertia), names[c]) for i, d, c in found), key=str)


def vectors(kind, n, size, r):
    if kind == "spread":
        return [[r.uniform(-1, 1) for _ in range(size)] for _ in range(n)]
    middles = [[r.uniform(-3, 3) for _ in range(size)] for _ in range(12)]
    noise = 0.2 if kind == "clusters" else 0
    return [[x + r.uniform(-noise, noise) for x in r.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_lloyd_equals_brute_force(spark, kind):
    r = random.Random(4)
    data = list(enumerate(vectors(kind, 700, 5, r)))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = lloyd.lloyd(df, rounds=4, size=5, block=64)
    assert sorted(map(tuple, got.collect()), key=str) == brute(data, 8, 4, 5)


def test_odd_rows(spark):
    data = [
        (1, [0.5, -0.25]), (1, [0.5, -0.25]), (1, [9.0, 9.0]), (None, [0.1, 0.2]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0]),
        (9, [1.0, 2.0, 3.0]), (10, [-1e-9, 1e-9]), (11, [0.5, -0.25]),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("p", F.lit("x")).withColumn("cluster", F.lit(3)).withColumn("block", F.lit(1))
    for k in (2, 8):
        assert sorted(map(tuple, lloyd.lloyd(df, k=k, rounds=3, size=2).collect()), key=str) == brute(data, k, 3, 2)
    assert lloyd.lloyd(df.where("false"), size=2).collect() == []
    assert lloyd.lloyd(df, size=7).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        lloyd.lloyd(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), size=2).collect()


def test_trees_cover_and_prune():
    r = np.random.default_rng(0)
    middles = r.integers(-1000, 1000, (30, 16))
    for points in (r.integers(-50, 50, (900, 2)), middles[r.integers(0, 30, 1000)] + r.integers(-20, 20, (1000, 16)), np.zeros((40, 3), np.int64), r.integers(-(1 << 27), 1 << 27, (500, 8))):
        tree, n = lloyd.Tree(points), len(points)
        assert sorted(tree.order) == list(range(n))
        laid = points[tree.order]
        for first, middle, radius in tree.levels:
            for a, b, m, most in zip(first, [*first[1:], n], middle, radius, strict=True):
                assert a <= m < b and np.sqrt(((laid[a:b] - laid[m].astype(float)) ** 2).sum(axis=1)).max() <= most * (1 + 1e-12)
        for k in (1, 3, 40):
            centres = laid[r.integers(0, n, k)]
            label, computed = lloyd.assign(laid, tree.levels, lloyd.Centroids(centres.tolist()))
            assert (label == ((laid[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
            assert computed <= n * k
    assert computed < n * k
    tree = lloyd.Tree(middles[r.integers(0, 30, 1000)] + 0)
    assert len(tree.levels[-1][0]) == 30 and tree.levels[-1][2].max() == 0  # copies end in one leaf
