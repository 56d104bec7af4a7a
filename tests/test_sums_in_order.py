"""Means at a limit: sums in the table's order, however its rows are dealt, and rounding of the double itself."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from lexiflow.plans import QUERIES, SQL


def test_sentence_scores_of_split_files_equal_sql(spark, tmp_path):
    import duckdb

    r = random.Random(3)
    (tmp_path / "lineitem.parquet").mkdir()
    rows = [(r.randrange(3000), r.randrange(11) / 100, r.randrange(9) / 100) for _ in range(15000)]
    for i in range(5):  # the lines of an order lie in several files
        keys, discounts, taxes = zip(*rows[3000 * i : 3000 * (i + 1)], strict=True)
        pq.write_table(pa.table({"l_orderkey": keys, "l_discount": discounts, "l_tax": taxes}), tmp_path / f"lineitem.parquet/part-{i}.parquet")
    con = duckdb.connect(config={"threads": 1})  # several add up in any order
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    theirs = sorted(con.execute(SQL["sentence_scores"]).fetchall())
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a task for each file
    try:
        ours = sorted(tuple(x) for x in QUERIES["sentence_scores"](spark, str(tmp_path)).select("l_orderkey", "score", "confidence", "passed").collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ours == theirs
