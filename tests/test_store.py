"""Shared stores: values put once by several writers, rows updated where they lie; splits of rows without a group."""

from pathlib import Path

from pyspark.sql import functions as F

from lexiflow.operators import splits
from lexiflow.sources.store import Store, read_buckets, update_buckets, write_buckets

SCHEMA = "key string, blob string"


def rows(spark, *keys):
    return spark.createDataFrame([(k, f"blob {k}") for k in keys], SCHEMA)


def keys(store):
    return sorted(r["key"] for r in store.rows().collect())


def test_values_are_put_once(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s"), SCHEMA), Store(spark, str(tmp_path / "s"), SCHEMA)
    assert keys(one) == []
    assert one.put(rows(spark, "a", "b", "b"), "one", 0) == 2
    assert two.put(rows(spark, "b", "c"), "two", 0) == 1
    assert one.put(rows(spark, "x"), "one", 0) == 0  # a replayed batch is passed over, whatever it holds
    assert one.put(rows(spark, "a", "c"), "one", 1) == 0
    assert keys(two) == ["a", "b", "c"] and [(e["writer"], e["batch"]) for e in one.log()] == [("one", 0), ("two", 0), ("one", 1)]


def test_the_second_of_two_writers_looks_again(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s"), SCHEMA), Store(spark, str(tmp_path / "s"), SCHEMA)
    take, built = one._take, []

    def late(entry):  # between the look-up and the commit of one, two commits
        if not built[1:]:
            built.append("late")
            two.put(rows(spark, "b", "c"), "two", 0)
        return take(entry)

    def build(fresh):
        built.append("build")
        return fresh.withColumn("blob", F.lit("built"))

    one._take = late
    assert one.put(rows(spark, "a", "b"), "one", 0, build) == 1
    assert built == ["build", "late"]  # values aren't built anew for the second try
    assert sorted((r["key"], r["blob"]) for r in one.rows().collect()) == [("a", "built"), ("b", "blob b"), ("c", "blob c")]
    assert not [p for p in Path(tmp_path / "s" / "log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string, n int"
    data = [(i, f"v{i}", i) for i in range(400)] + [(None, "none", 0)]
    write_buckets(spark.createDataFrame(data, schema), path, "k", 16)
    files = lambda: {p.parent.name + "/" + p.name: p.stat().st_mtime_ns for p in Path(path).glob("_bucket=*/*.parquet")}
    before = files()
    new = spark.createDataFrame([(7, "new", None), (7, "newer", None), (9000, "no row", 1)], schema)
    assert update_buckets(spark, path, schema, new, "k", 16) <= 2
    after = files()
    same = {k for k in before if after.get(k) == before[k]}
    assert len({k.split("/")[0] for k in set(before) - same}) <= 2 and len(same) >= len(before) - 2
    got = sorted(((r.k, r.v, r.n) for r in read_buckets(spark, path, schema).collect()), key=str)
    assert got == sorted(((k, "newer" if k == 7 else v, n) for k, v, n in data), key=str)


def test_rows_without_a_group_are_split(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "g string, i int")
    got = splits.group_split(df, "g", {"train": 0.5, "test": 0.5}, "5").collect()
    assert sorted(r["i"] for r in got) == [1, 2, 3, 4] and len({r["split"] for r in got if r["g"] is None}) == 1
