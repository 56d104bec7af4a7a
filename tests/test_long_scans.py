"""Scans that look ahead over a long key: the next value as a plain walk gives it, without a frame that is made anew for each row."""

import random

from pyspark.sql import functions as F

from lexiflow.operators import scans


def test_next_over_a_long_key(spark):
    r = random.Random(4)
    data = [(1 if r.random() < 0.9 else None, i, i * 3 if r.random() < 0.01 else None) for i in range(20000)]
    found = scans.scanned(scans.ordered(spark.createDataFrame(data, "k int, i long, v long"), ["k"], ["i"]), ahead=("next", F.col("v")), then=("after", F.col("v")))
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    want, nearest, after = {}, {}, {}
    for k, i, v in reversed(data):
        nearest[k] = nearest.get(k) if v is None else v
        want[k, i] = (nearest[k], after.get(k))
        after[k] = v
    assert {(x.k, x.i): (x.ahead, x.then) for x in found.collect()} == want
