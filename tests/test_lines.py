"""Lines of large files, numbered by several tasks."""

from lexiflow.sources.lexicon import read_lexicon
from lexiflow.sources.lines import numbered_lines


def test_lines_of_split_files(spark, tmp_path):
    texts = {"a.txt": "".join(f"line {i}{'x' * (i % 90)}" + ("\r\n" if i % 3 else "\n") for i in range(6000)), "b.txt": "\n\nlast without an end", "c.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {(r["file"].rsplit("/", 1)[-1], r["line_no"]): r["line"] for r in numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(name, i): line for name, text in texts.items() for i, line in enumerate(text.replace("\r\n", "\n").split("\n")) if line or not text.endswith("\n") and name != "c.txt" or i < text.count("\n")}


def test_policies_over_several_files(spark, tmp_path):
    (tmp_path / "1.txt").write_text("word 0.5 A\nother 0.9 B\n")
    (tmp_path / "2.txt").write_text("word 0.5 C\nother 0.2 D\nword 0.1 E\n")
    best = {r["word"]: r["phones"] for r in read_lexicon(spark, str(tmp_path), "best").collect()}
    last = {r["word"]: r["phones"] for r in read_lexicon(spark, str(tmp_path), "last", 3).collect()}
    assert best == {"word": ["A"], "other": ["B"]} and last == {"word": ["E"], "other": ["D"]}
    every = sorted((r["file"][-5:], r["line_no"], r["word"], r["phones"]) for r in read_lexicon(spark, str(tmp_path)).collect())
    assert every == [("1.txt", 0, "word", ["A"]), ("1.txt", 1, "other", ["B"]), ("2.txt", 0, "word", ["C"]), ("2.txt", 1, "other", ["D"]), ("2.txt", 2, "word", ["E"])]
