"""Queries over whole texts, against brute force on small tables."""

from lexiflow.plans import QUERIES


def test_merged_transcripts_keep_whole_texts(spark, tmp_path):
    texts = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate([1, 3, 20, 60, 200])] + ["", None]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x.turn: x.merged for x in QUERIES["merged_transcripts"](spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in range(6)} == dict(enumerate(texts[:6])) and len(got) == 7


def test_script_ratios_whole_normalises_whole_texts(spark, tmp_path):
    texts = ["  ABC " * 50, "x" * 30 + "LAST\n", " \t"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.norm for x in QUERIES["script_ratios_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: t.strip(" \n\t").lower() for i, t in enumerate(texts)}
