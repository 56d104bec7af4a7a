"""Audio sessions as a stream: de-overlap, a byte-bounded window, votes, emission gate and closing.

``transformWithState`` keeps, for each session, one row of numbers and texts and a list of the chunks in the window; both
expire when a session is silent for good. A partial text that waits for its lag goes out by a timer even if no chunk
follows. Chunks carry their arrival in milliseconds, which is the session's clock, so a replay gives the same results.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.streams import _sounds, merge_overlap
from .sessions import rolling, without_overlap

log = logging.getLogger(__name__)
#: Level above which a frame, or a chunk without votes, is speech.
FLOOR_DB = -40.0
#: What state stores need for lists and timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHUNKS = "session_id string, seq long, event string, at_ms long, overlap_ms int, payload binary"
OUTPUT = "session_id string, segment int, kind string, text string, n_bytes long, level_db double, out_of_order long"
STATE = "segment int, started boolean, partial string, waiting string, voice_ms long, emit_ms long, n_bytes long, squares double, last_seq long, out_of_order long"


@dataclass(frozen=True)
class Limits:
    """Sample rate, seconds of the window and of the longest segment, milliseconds of a frame, and the gates of emission and closing."""

    rate: int = 16_000
    window_s: float = 1.3
    longest_s: float = 12.0
    frame_ms: int = 20
    votes: bool = True
    gain: int = 2
    lag_ms: int = 900
    least: int = 3
    silence_ms: int = 700


@dataclass
class Session:
    """A session between chunks; ``ring`` is the window, ``squares`` the sum of squared samples of the segment."""

    segment: int = 0
    started: bool = False
    partial: str = ""
    waiting: str = ""
    voice_ms: int = -1
    emit_ms: int = 0
    n_bytes: int = 0
    squares: float = 0.0
    last_seq: int = -1
    out_of_order: int = 0
    ring: bytes = field(default=b"", compare=False)


def samples(payload: bytes) -> np.ndarray:
    """16-bit samples within -1 and 1; an odd last byte is none."""
    return np.frombuffer(payload[: len(payload) // 2 * 2], "<i2") / 32768.0


def level(squares: float, n: int) -> float:
    """Level in dB of ``n`` samples (H42); -100 without any."""
    return float(20 * np.log10(np.sqrt(squares / n + 1e-12) + 1e-12)) if n else -100.0


def frame_votes(payload: bytes, rate: int, frame_ms: int) -> list[bool]:
    """Whether each whole frame is above the floor (I10); a rest shorter than a frame has no vote."""
    size = max(1, rate * frame_ms // 1000)
    x = samples(payload)
    return [level(float((f * f).sum()), size) > FLOOR_DB for f in x[: len(x) // size * size].reshape(-1, size)]


def voiced(votes: list[bool] | None, level_db: float, floor_db: float = FLOOR_DB) -> bool:
    """At least half of the votes; none at all is no speech. Without a voter (None) the level decides."""
    if votes is None:
        return level_db > floor_db
    return bool(votes) and 2 * sum(votes) >= len(votes)


def advance(now: Session, chunk: dict, decode: Callable[[bytes], str], limits: Limits) -> tuple[Session, list[tuple]]:
    """One chunk of a session: its next state and what goes out (segment, kind, text, n_bytes, level_db, out_of_order).

    Bytes that the chunk before held too are dropped, but for a segment's first chunk (I2); the window keeps the last bytes
    (I3) and is decoded anew. A decoded text of ``least`` letters is merged to the partial one, which goes out once it gains
    ``gain`` letters or ``lag_ms`` has passed (I4, I5). Silence of ``silence_ms`` closes the segment, or a silent chunk once it is
    ``longest_s`` long (I6); an end of stream closes it too (I7). Empty chunks are passed over, and chunks whose seq isn't
    the next one are counted (I8). A final row has the bytes and the level of the segment (I9).
    """
    out: list[tuple] = []
    final = lambda s: (s.segment, "final", s.waiting or s.partial, s.n_bytes, round(level(s.squares, s.n_bytes // 2), 6), s.out_of_order)
    if chunk["event"] == "eos":
        if now.n_bytes:
            out.append(final(now))
        return Session(segment=now.segment + 1, last_seq=now.last_seq, out_of_order=now.out_of_order), out
    raw, at = bytes(chunk["payload"] or b""), chunk["at_ms"]
    if not raw:
        return now, out
    late = now.out_of_order + (chunk["seq"] != now.last_seq + 1)
    if late > now.out_of_order:
        log.warning("chunk %s after %s", chunk["seq"], now.last_seq)
    overlap = int(limits.rate * (chunk["overlap_ms"] or 0) / 1000.0) * 2
    core = without_overlap(raw, min(overlap, len(raw)), not now.started)
    x = samples(core)
    squares = float((x * x).sum())
    s = replace(now, started=True, last_seq=chunk["seq"], out_of_order=late, n_bytes=now.n_bytes + len(core), squares=now.squares + squares, voice_ms=at if now.voice_ms < 0 else now.voice_ms, ring=rolling(now.ring, core, int(2 * limits.rate * limits.window_s)))
    said = decode(s.ring)
    if said and len(_sounds(said)) >= limits.least:
        merged = merge_overlap(s.partial, said)
        s.waiting = merged if merged != s.partial else ""
        if len(_sounds(merged)) - len(_sounds(s.partial)) >= limits.gain or at - s.emit_ms >= limits.lag_ms:
            s.partial, s.waiting, s.emit_ms = merged, "", at
            out.append((s.segment, "partial", merged, s.n_bytes, None, late))
    if voiced(frame_votes(core, limits.rate, limits.frame_ms) if limits.votes else None, level(squares, len(x))):
        s.voice_ms = at
    elif at - s.voice_ms >= limits.silence_ms or s.n_bytes / 2 / limits.rate >= limits.longest_s:
        out.append(final(s))
        s = Session(segment=s.segment + 1, voice_ms=at, last_seq=s.last_seq, out_of_order=late)
    return s, out


class Recogniser(StatefulProcessor):
    """``advance`` over the chunks of each session, in the order of their arrival."""

    def __init__(self, decode: Callable[[bytes], str], limits: Limits, ttl_ms: int):
        self.decode, self.limits, self.ttl_ms = decode, limits, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", STATE, self.ttl_ms)
        self.ring = handle.getListState("ring", "chunk binary", self.ttl_ms)

    def _load(self) -> Session:
        if not self.numbers.exists():
            return Session()
        ring = b"".join(bytes(x[0]) for x in self.ring.get()) if self.ring.exists() else b""
        return Session(*self.numbers.get(), ring=ring)

    def _save(self, now: Session, timer_ms: int) -> None:
        self.numbers.update(tuple(astuple(now)[:-1]))
        # The window as chunks of a bounded size, so that no value of the store is large.
        self.ring.put([(now.ring[i : i + 16384],) for i in range(0, len(now.ring), 16384)]) if now.ring else self.ring.clear()
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if now.waiting:
            self.handle.registerTimer(timer_ms + self.limits.lag_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now, out = self._load(), []
        for chunk in sorted((r.asDict() for r in rows), key=lambda r: (r["at_ms"], r["seq"])):
            now, made = advance(now, chunk, self.decode, self.limits)
            out += made
        self._save(now, timerValues.getCurrentProcessingTimeInMs())
        for x in out:
            yield Row(session_id=key[0], segment=x[0], kind=x[1], text=x[2], n_bytes=x[3], level_db=x[4], out_of_order=x[5])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = self._load()
        if now.waiting:
            now.partial, now.waiting = now.waiting, ""
            self._save(now, 0)
            yield Row(session_id=key[0], segment=now.segment, kind="partial", text=now.partial, n_bytes=now.n_bytes, level_db=None, out_of_order=now.out_of_order)

    def close(self) -> None:
        pass


def audio_sessions(chunks: DataFrame, decode: Callable[[bytes], str], limits: Limits = Limits(), ttl_ms: int = 3_600_000) -> DataFrame:  # noqa: B008
    """Partial and final rows of a stream of ``CHUNKS``; the session's state store must be the one of ``PROVIDER``.

    ``decode`` gives the text of a window of bytes. State of a session expires ``ttl_ms`` after its last chunk.
    """
    return chunks.groupBy("session_id").transformWithState(Recogniser(decode, limits, ttl_ms), OUTPUT, "append", "processingTime")
