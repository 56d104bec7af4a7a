"""Readers and writers on small files, and streams on small folders."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.sources import jsonl, lexicon, textgrid
from lexiflow.streaming import sessions

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


@pytest.fixture
def lines(tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "t": "가"}\n\n{"id": 2\n{"id": 3, "t": null}\n')
    return str(p)


def test_tolerant_and_marked(spark, lines):
    assert sorted(r.id for r in jsonl.read_tolerant(spark, lines, SCHEMA).collect()) == [1, 3]
    marked = jsonl.read_marked(spark, lines, SCHEMA).cache()
    assert jsonl.drop_counts(marked).first()[1:] == (3, 1)


def test_strict(spark, lines):
    with pytest.raises(Exception, match="MALFORMED"):
        jsonl.read_strict(spark, lines, SCHEMA).collect()


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "한글 \"q\""), (2, None)], SCHEMA)
    out = str(tmp_path / "o")
    jsonl.write_jsonl(df, out)
    jsonl.append_jsonl(df, out)
    assert spark.read.schema(SCHEMA).json(out).count() == 4
    assert any("한글" in p.read_text() for p in (tmp_path / "o").glob("part-*"))


def test_alignment_synonyms(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿Start,FINISH,text,Type\n0.0,1.5,가,Words\n")
    r = jsonl.read_alignment(spark, str(p)).first()
    assert (r.begin, r.end, r.label, r.type, r.speaker) == (0.0, 1.5, "가", "words", "corpus")
    (tmp_path / "b.csv").write_text("begin,label\n1,x\n")
    with pytest.raises(ValueError, match="end, type"):
        jsonl.read_alignment(spark, str(tmp_path / "b.csv"))


def test_filelist_and_listing(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a.wav|1|text one\nbad line\n")
    assert jsonl.read_filelist(spark, str(tmp_path / "f.txt"), ["path", "sid", "text"]).count() == 1
    (tmp_path / "x.wav").write_bytes(b"1")
    (tmp_path / "x.TextGrid").write_text("x")
    audio, notes = (jsonl.list_files(spark, str(tmp_path), e) for e in ("wav", "TextGrid"))
    assert jsonl.pairs_by_stem(audio, notes).count() == 1


def test_lexicon_policies(spark, tmp_path):
    p = tmp_path / "d.dict"
    p.write_text("가\t0.2\tk a\n가\t0.9\tg a\n가 0.1 0 0 0 kk a\n나 n a sil\n")
    assert {tuple(r.phones) for r in lexicon.read_lexicon(spark, str(p)).where("word = '가'").collect()} == {("k", "a"), ("g", "a"), ("kk", "a")}
    assert lexicon.read_lexicon(spark, str(p), "best").where("word = '가'").first().phones == ["g", "a"]
    assert lexicon.read_lexicon(spark, str(p), "last", 6).where("word = '가'").first().phones == ["kk", "a"]


GRID = '''class = "IntervalTier"
        name = "words"
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = "가 ""나"""
        class = "IntervalTier"
        name = "phones"
        intervals [1]:
            xmin = 0
            xmax = 0.2
            text = "k"
'''


def test_textgrid(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text(GRID)
    grid = textgrid.read_textgrids(spark, str(tmp_path / "a.TextGrid"))
    assert [(r.label, r.end) for r in textgrid.pick_tier(grid, "word").collect()] == [('가 "나"', 0.5)]
    assert textgrid.pick_tier(grid, "phones").first().label == "k"


def test_streaming_dedup(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"event_id": f"e{k}", "ts": "2024-01-01T00:00:00"}) for k in range(3)))
    stream = sessions.tail(spark, str(src), "event_id string, ts timestamp", 1)
    q = sessions.deduplicated(stream).writeStream.format("memory").queryName("dedup_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup_out").count() == 3


def test_recogniser_step():
    now, out = (0, False, "", "", 0, 0, 0), []
    for text, speech in (("안녕하", True), ("녕하세요", True), ("", False), ("", False)):
        now, made = sessions.step(now, {"event": "chunk", "text": text, "speech": speech, "chunk_ms": 400})
        out += made
    assert out == [("partial", "안녕하", 400), ("partial", "안녕하세요", 800), ("final", "안녕하세요", 1600)]
    assert now[0] == 1
    assert sessions.without_overlap(b"abcd", 2, False) == b"cd" and sessions.rolling(b"abc", b"de", 4) == b"bcde"


def test_recogniser_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("s", i, "chunk", "hello there"[: 5 + 3 * i], i < 2, 400) for i in range(4)] + [("t", 0, "chunk", "abc", True, 100), ("t", 1, "eos", "", False, 0)]
    names = ("session_id", "seq", "event", "text", "speech", "chunk_ms")
    (src / "a.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
    stream = sessions.tail(spark, str(src), "session_id string, seq long, event string, text string, speech boolean, chunk_ms long")
    q = sessions.recognised(stream).writeStream.format("memory").queryName("asr_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    finals = {(r.session_id, r.kind) for r in spark.table("asr_out").where(F.col("kind") == "final").collect()}
    assert finals == {("s", "final"), ("t", "final")}


def test_recogniser_stream_keeps_the_order_of_arrival(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("s", 0, "chunk", "first", True, 100), ("s", 5, "chunk", "", True, 100), ("s", 2, "chunk", "second", True, 100), ("s", 6, "eos", "", False, 0)]
    names = ("session_id", "seq", "event", "text", "speech", "chunk_ms")
    (src / "a.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
    stream = sessions.tail(spark, str(src), "session_id string, seq long, event string, text string, speech boolean, chunk_ms long")
    q = sessions.recognised(stream).writeStream.format("memory").queryName("asr_order").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.kind, r.text, r.out_of_order) for r in spark.table("asr_order").collect()]
    assert got == [("partial", "first", 0), ("partial", "first second", 1), ("final", "first second", 1)]
