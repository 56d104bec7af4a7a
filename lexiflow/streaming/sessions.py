"""Streaming ingestion, sessions and the incremental recogniser state."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.streams import merge_overlap

log = logging.getLogger(__name__)
#: State of a session before its first chunk.
FRESH = (0, False, "", "", 0, 0, 0)
OUTPUT = "session_id string, segment int, kind string, text string, duration_ms long, out_of_order long"
STATE = "segment int, started boolean, partial string, emitted string, length_ms long, silent_ms long, lag_ms long, last_seq long, out_of_order long"


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """First event of each id; ids are forgotten once the watermark has passed them."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "5 minutes", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts of each kind in windows of event time."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def gap_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "700 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Sessions that close after a gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def tail(spark, path: str, schema: str, files: int = 100) -> DataFrame:
    """Append-only JSON lines as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def without_overlap(payload, overlap_bytes: int, first: bool):
    """A chunk without the bytes that the one before held too; the first of a segment is whole."""
    return payload if first else payload[overlap_bytes:]


def rolling(buffer: bytes, chunk: bytes, keep: int) -> bytes:
    """The last ``keep`` bytes."""
    return (buffer + chunk)[-keep:]


def step(state: tuple, chunk: dict, gain: int = 2, lag_ms: int = 900, least: int = 3, silence_ms: int = 700, longest_ms: int = 12_000) -> tuple[tuple, list[tuple]]:
    """One chunk of a session: new state and emissions (kind, text, duration).

    A partial text goes out once it gains ``gain`` characters or ``lag_ms`` has passed, and has ``least`` characters. Silence
    closes the segment after ``silence_ms``, or, on a silent chunk only, at ``longest_ms``; an end of stream closes it too.
    """
    segment, _, partial, emitted, length, silent, lag = state
    out: list[tuple] = []
    if chunk["event"] == "eos":
        if length:
            out.append(("final", partial, length))
        return (segment + 1, False, "", "", 0, 0, 0), out
    length, lag = length + chunk["chunk_ms"], lag + chunk["chunk_ms"]
    if chunk["text"]:
        partial = merge_overlap(partial, chunk["text"])
    if len(partial) >= least and partial != emitted and (len(partial) - len(emitted) >= gain or lag >= lag_ms):
        out.append(("partial", partial, length))
        emitted, lag = partial, 0
    if chunk["speech"]:
        silent = 0
    else:
        silent += chunk["chunk_ms"]
        if silent >= silence_ms or length >= longest_ms:
            out.append(("final", partial, length))
            return (segment + 1, False, "", "", 0, 0, 0), out
    return (segment, True, partial, emitted, length, silent, lag), out


def recognised(chunks: DataFrame, idle: str | None = None) -> DataFrame:
    """Partial and final texts of sessions from a stream of chunks (session_id, seq, event, text, speech, chunk_ms).

    Chunks run in the order in which they come: one whose seq doesn't exceed that before it is processed where it
    comes, and only counted and logged (``out_of_order``, I8). With ``idle``, a session without chunks for so long
    (in processing time) gives out what it holds and its state is dropped.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *now, last, late = state.get if state.exists else (*FRESH, -1, 0)
        out = []
        if state.hasTimedOut:
            if now[4]:
                out.append((key[0], now[0], "final", now[2], now[4], late))
            state.remove()
        else:
            for frame in frames:
                for row in frame.to_dict("records"):
                    if row["seq"] <= last:
                        late += 1
                        log.warning("session %s: chunk %s after %s", key[0], row["seq"], last)
                    segment, last = now[0], row["seq"]
                    now, made = step(tuple(now), row)
                    out += [(key[0], segment, kind, text, duration, late) for kind, text, duration in made]
            state.update((*now, last, late))
            if idle:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["session_id", "segment", "kind", "text", "duration_ms", "out_of_order"])

    kind = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return chunks.groupBy("session_id").applyInPandasWithState(run, OUTPUT, STATE, "append", kind)
