"""Functions by name in SQL, and greedy covers, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import registry
from lexiflow.operators import align, cover
from lexiflow.operators.splits import seeded
from lexiflow.plans import QUERIES


@pytest.fixture(scope="module")
def own(spark):
    session = spark.newSession()
    registry.register(session)
    return session


def test_pairs_in_sql_equal_the_column_function(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.split("p_name", "").alias("a"), F.split(F.reverse("p_name"), "").alias("b"))
    want = p.select("p_partkey", F.posexplode(align.aligned()("a", "b")["pairs"]).alias("place", "x")).select("p_partkey", "place", "x.ri", "x.hj")
    assert sorted(map(tuple, QUERIES["sql_aligned_pairs"](spark, sf_dir).collect())) == sorted(map(tuple, want.collect()))


def test_odd_arguments(own):
    assert own.sql("SELECT * FROM align_pairs(CAST(NULL AS ARRAY<STRING>), array('x'), -1, -1)").collect() == [(0, -1, 0)]
    assert own.sql("SELECT * FROM align_pairs(array(), array(), -1, -1)").collect() == []
    with pytest.raises(Exception, match="arrays of strings"):
        own.sql("SELECT * FROM align_pairs('x', array('x'), -1, -1)").collect()
    assert own.sql("SELECT clean_text(CAST(NULL AS STRING), 'lowercase') AS a, clean_text('  A  b ', 'collapse, lowercase') AS b, clean_text('A', 'lowercase') AS c").first() == (None, "a b", "a")
    own.createDataFrame([(None, 1, "x"), (None, 2, None), (None, 3, None), ("k", 1, "y"), ("k", 2, "y"), ("k", 3, "x")], "k string, o int, l string").createOrReplaceTempView("t")
    got = sorted(own.sql("SELECT * FROM label_runs(TABLE(t), key => 'k', label => 'l', `order` => 'o')").collect(), key=str)
    assert got == sorted([(None, 1, "x", 1, 1), (None, 2, None, 2, 3), ("k", 1, "y", 1, 2), ("k", 2, "x", 3, 3)], key=str)
    with pytest.raises(Exception, match="no column"):
        own.sql("SELECT * FROM label_runs(TABLE(t), key => 'z', label => 'l', `order` => 'o')").collect()


def greedy(texts, rank):
    left, out = set().union(*texts.values()), []
    while left:
        best = min((t for t in texts if texts[t] & left), key=lambda t: (-len(texts[t] & left), rank[t], t))
        out.append((best, len(texts[best] & left)))
        left -= texts[best]
    return sorted(out)


def test_cover_equals_one_at_a_time(spark):
    r = random.Random(4)
    texts = {i: {f"u{int(r.random() ** 2 * 40)}" for _ in range(r.randrange(1, 9))} for i in range(60)}
    rows = [(i, sorted(u)) for i, u in texts.items()] + [(3, sorted(texts[3])), (100, []), (101, None), (None, ["u0"]), (4, [None])]
    df = spark.createDataFrame(rows, "id long, units array<string>")
    rank = {r.id: r.h for r in df.select("id", seeded("id", "s").alias("h")).collect()}
    assert sorted(map(tuple, cover.greedy_cover(df, "id", "units", "s").collect())) == greedy(texts, rank)
    assert cover.greedy_cover(df.where("false"), "id", "units").collect() == []


def test_covering_names_cover_the_column_as_one_at_a_time(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rank = {r.p_partkey: r.h for r in p.select("p_partkey", seeded("p_partkey", "7").alias("h")).collect()}
    texts = {r.p_partkey: {x[i : i + 3] for x in [f"{r.p_name} {r.p_brand} {r.p_type}"] for i in range(len(x) - 2)} for r in p.collect()}
    got = sorted(map(tuple, QUERIES["covering_names"](spark, sf_dir).collect()))
    assert got == greedy(texts, rank)
    assert set().union(*(texts[i] for i, _ in got)) == set().union(*texts.values())
