"""State machines over streams and quantiles, without a whole key or table in one task."""

import random
from functools import partial

from pyspark.sql import functions as F

from lexiflow.operators import records, state
from lexiflow.plans import QUERIES


def test_streamed_equals_lists(spark):
    r = random.Random(5)
    data = [(r.choice([1, 1, 1, 2, None]), i, r.random() < 0.6, " ".join(r.choice("abc") for _ in range(4))) for i in range(900)]
    df = spark.createDataFrame(data, "k long, i long, voiced boolean, text string").withColumn("s", F.col("i") * 10).withColumn("e", F.col("s") + 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys go over many batches
    try:
        for whole, steps, columns, schema in (
            (partial(state.hysteresis, start_ms=20, end_ms=30), partial(state.hysteresis_steps, start_ms=20, end_ms=30), ["voiced"], "a long, b long"),
            (partial(state.pack_to_target, target=50, least=20, most=40), partial(state.pack_to_target_steps, target=50, least=20, most=40), ["s", "e", "voiced"], "a long, b long"),
            (partial(state.unlike_last_kept, threshold=0.9), partial(state.unlike_last_kept_steps, threshold=0.9), ["i", "text"], "kept long"),
        ):
            got = sorted(map(tuple, state.per_key_streamed(df, "k", ["i"], steps, columns, schema).collect()), key=str)
            rows = df.collect()
            want = [(k, *x) for k in (1, 2, None) for x in whole([tuple(row[c] for c in columns) for row in rows if row["k"] == k])]
            assert got == sorted(want, key=str) and len(got) > 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_key_in_one_frame(spark, sf_dir):
    for name in ("near_dup_prev_kept", "vad_hysteresis", "pack_intervals"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    assert "percentile" not in QUERIES["margin_score"](spark, sf_dir)._jdf.queryExecution().toString()


def test_exact_quantile_equals_percentile(spark):
    r = random.Random(6)
    for values in ([r.randrange(40) / 8 for _ in range(301)], [3.5], [1.0, 2.0], [None, 1.0, None, 4.0], [2.0] * 50, [None], []):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for q in (0.0, 0.6, 1.0):
            assert records.exact_quantile(df, "v", q).first()[0] == df.agg(F.percentile("v", F.lit(q))).first()[0]
