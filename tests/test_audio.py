"""Audio sessions: parts of the state machine, restarts in the middle of a session, and the timer of a waiting text."""

import math
import time

import numpy as np

from lexiflow.streaming import audio

LIMITS = audio.Limits(rate=1000, window_s=0.3, frame_ms=50, longest_s=2.0)


def letters(window):
    return bytes(x for x in window if 97 <= x <= 122).decode()


def chunk(seq, payload, overlap=0, event="chunk", step=250):
    return {"seq": seq, "event": event, "at_ms": 10_000 + step * seq, "overlap_ms": overlap, "payload": payload}


def fold(chunks, limits=LIMITS):
    now, out = audio.Session(), []
    for c in chunks:
        now, made = audio.advance(now, c, letters, limits)
        out += made
    return now, out


def test_votes_and_level():
    loud, quiet = b"\x00\x40" * 50, b"\x00\x00" * 50
    assert audio.frame_votes(loud + quiet + b"xx", 1000, 50) == [True, False]
    assert audio.voiced([True, False], -90) and not audio.voiced([True, False, False], 0) and not audio.voiced([], 0)
    assert audio.voiced(None, -39.9) and not audio.voiced(None, -40.0)
    assert audio.level(0.0, 0) == -100.0 and math.isclose(audio.level(float((audio.samples(loud) ** 2).sum()), 50), 20 * math.log10(0.5), abs_tol=1e-6)
    assert len(audio.samples(b"abc")) == 1 and np.isclose(audio.samples(b"\x00\x80")[0], -1)


def test_overlap_is_dropped_but_for_the_first_chunk_and_the_window_is_bounded():
    first = b"ab" * 250
    now, _ = fold([chunk(0, first, 50), chunk(1, first[-100:] + b"cd" * 100, 50)])
    assert now.n_bytes == 700 and now.ring == (first + b"cd" * 100)[-600:]
    now, _ = fold([chunk(0, b"", 0), chunk(1, b"ab", 5000), chunk(2, b"zz", 5000)])
    assert now.ring == b"ab" and now.started and now.out_of_order == 1  # nothing is left of a chunk shorter than its overlap


def test_gate_and_closing():
    silent = bytes(500)
    now, out = fold([chunk(0, b"abcdef"), chunk(1, b"g"), chunk(2, silent), chunk(3, silent), chunk(4, silent), chunk(5, b"xyz"), chunk(9, b"", event="eos")])
    kinds = [(s, kind, text, n) for s, kind, text, n, _, _ in out]
    # One more letter is too little to go out before the lag, but it is in the final text.
    assert kinds == [(0, "partial", "abcdef", 6), (0, "final", "abcdefg", 1007), (1, "partial", "xyz", 503), (1, "final", "xyz", 503)]
    assert now == audio.Session(segment=2, last_seq=5)
    loud = b"\x61\x40" * 250  # speech never closes by itself; a silent chunk after the longest time does
    _, out = fold([*(chunk(i, loud) for i in range(9)), chunk(9, silent)])
    assert [x[1] for x in out].count("final") == 1 and out[-1][3] == 5000


def write(spark, path, rows):
    spark.createDataFrame(rows, audio.CHUNKS).coalesce(1).write.mode("append").parquet(path)


def session(spark):
    own = spark.newSession()
    own.conf.set(*audio.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def test_restart_in_the_middle_of_a_session(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for name in ("a", "b", "c"):
        seqs = [0, 1, 2, 4, 3, 5, 6, 7, 8, 9]
        for place, seq in enumerate(seqs):
            payload = bytes(rng.integers(97, 123, 500).astype(np.uint8)) if rng.random() < 0.6 else bytes(500)
            rows.append((name, seq, "chunk", 10_000 + 250 * place, 50 if place else 0, payload))
        rows.append((name, 10, "eos", 20_000, 0, b""))
    want = []
    for name in ("a", "b", "c"):
        _, out = fold([dict(zip(("seq", "event", "at_ms", "overlap_ms", "payload"), r[1:], strict=True)) for r in rows if r[0] == name])
        want += [(name, *x) for x in out]
    own = session(spark)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for part in (rows[:4] + rows[11:17], rows[4:11] + rows[17:22] + rows[22:]):  # sessions a and b go on after the restart
        write(spark, str(tmp_path / "in"), part)
        stream = audio.audio_sessions(own.readStream.schema(audio.CHUNKS).parquet(str(tmp_path / "in")), letters, LIMITS)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(x[2] == "final" for x in got) and max(x[-1] for x in got) > 0


def test_waiting_text_goes_out_by_the_timer(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [("t", 0, "chunk", 10_000, 0, b"abcdef"), ("t", 1, "chunk", 10_010, 0, b"g")])
    stream = audio.audio_sessions(session(spark).readStream.schema(audio.CHUNKS).parquet(str(tmp_path / "in")), letters, LIMITS)
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        texts = []
        while time.time() < until and "abcdefg" not in texts:
            time.sleep(1)
            texts = [r["text"] for r in spark.read.schema(audio.OUTPUT).parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out" / "_spark_metadata" / "0").exists() else []
    finally:
        run.stop()
    assert texts.count("abcdefg") == 1 and texts.count("abcdef") == 1
