"""Queries over whole tables, against brute force and row counts."""

from datetime import datetime, timedelta

from lexiflow.plans import QUERIES


def test_boundary_snaps_whole_equal_brute_force(spark, tmp_path):
    start = datetime(2024, 5, 1)
    data = [(i, (i * 7) % 60, start + timedelta(seconds=(i * 977) % 20_000), float((i * 31) % 17)) for i in range(300)]
    spark.createDataFrame(data, "event_id long, user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    at = {i: (t - datetime(1970, 1, 1)).total_seconds() for i, _, t, _ in data}
    want = {i: min((v, at[j]) for j, u, _, v in data if u == user and abs(at[j] - at[i]) <= 3600)[1] for i, user, _, _ in data}
    assert {x.event_id: x.snapped for x in QUERIES["boundary_snaps_whole"](spark, str(tmp_path)).collect()} == want
    assert any(want[i] != at[i] for i in want)


def test_whole_tables_give_all_rows(spark, sf_dir, tmp_path):
    spark.createDataFrame([(i, f"name {i % 7}") for i in range(900)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("char_error_rate_whole", "described_whole"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 900
