"""Monotonic paths of many rows: as the plain recursion gives them, and in time that grows with the rows, not with their square."""

import random

from pyspark.sql import functions as F

from lexiflow.operators import trellis
from lexiflow.plans import QUERIES


def plain(m):
    h, w = len(m), len(m[0])
    if h < w:
        return None
    best = [[0.0] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            stay, step = (best[y - 1][x] if x < y else -1e9), (best[y - 1][x - 1] if x and y else 0.0 if x == y == 0 else -1e9)
            best[y][x] = m[y][x] + max(stay, step)
    path, x = [], w - 1
    for y in range(h - 1, -1, -1):
        path.append(x)
        if y and x and (x == y or best[y - 1][x] < best[y - 1][x - 1]):
            x -= 1
    return path[::-1]


def test_paths_of_rows_equal_the_recursion(spark):
    r = random.Random(8)
    made = {k: [[r.randrange(40) / 4 for _ in range(w)] for _ in range(h)] for k, (h, w) in enumerate([(3000, 9), (20000, 4), (1, 1), (1, 2), (7, 7), (6, 7), *[(r.randrange(1, 60), r.randrange(1, 9)) for _ in range(300)]])}
    rows = [(None if k == 0 else k, y, v) for k, m in made.items() for y, v in enumerate(m)]
    r.shuffle(rows)
    got = {}
    for k, y, x in sorted((x.k or 0, x.y, x.x) for x in trellis.monotonic_paths(spark.createDataFrame(rows, "k int, y long, v array<double>"), ["k"]).collect()):
        got.setdefault(k, []).append(x)
    assert got == {k: p for k, m in made.items() if (p := plain(m)) is not None}
    one = spark.createDataFrame([(made[0],)], "m array<array<double>>").select(trellis.monotonic_path(F.col("m")).alias("p")).first().p
    assert one == plain(made[0])


def test_the_query_does_not_put_a_user_in_one_value(spark, sf_dir):
    plan = QUERIES["monotonic_paths"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan
