"""Joins of exploded rows, which are many more than Spark reckons from the files: none is broadcast through the driver."""

import pytest

from lexiflow.plans import QUERIES


@pytest.mark.parametrize("name", ["syllable_chunk_scores", "word_and_overall_scores"])
def test_no_broadcast_of_exploded_rows(spark, sf_dir, name):
    done = QUERIES[name](spark, sf_dir)
    plan = done._jdf.queryExecution()
    assert "Broadcast" not in plan.executedPlan().toString()
    done.collect()  # nor is it when sizes are known
    assert "Broadcast" not in plan.executedPlan().toString()
