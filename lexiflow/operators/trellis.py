"""Alignments over given emissions: forced CTC paths and confidences (K9), monotonic alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells (utterances x frames x states) that one step of the trellis holds.
CELLS = 1 << 21
#: Rows of a batch of paths.
ROWS = 1 << 14


@dataclass(frozen=True)
class Role:
    """How the frames of a unit of one role are judged.

    From three frames on, those before the share ``tail`` are left out; frames in which the unit leads the blank by less than
    ``delta`` too, if any others are left; then the best share ``top`` by probability stays. Margins to the ``rivals`` best
    labels of its class, the best share ``pool`` of them, pass a sigmoid of width ``width``; their mean is freed from ``bias``,
    raised to ``power`` and not below ``floor``.
    """

    tail: float = 0.0
    delta: float = 0.0
    top: float = 1.0
    rivals: int = 2
    pool: float = 1.0
    width: float = 0.25
    bias: float = 0.05
    power: float = 0.9
    floor: float = 0.0


def extended(labels: list[int], blank: int) -> list[int]:
    """Labels with blanks before, between and after them."""
    return [x for label in labels for x in (blank, label)] + [blank]


def forced_paths(batch: list[tuple[np.ndarray, list[int]]], blank: int) -> list[np.ndarray]:
    """The best state of each frame for utterances (log probabilities of frames x labels, labels).

    States are the extended labels; a path begins in the first or second, stays or goes on by one in every frame, and ends in
    the last but one or the last. Ties stay, and end in the last. All utterances of a batch advance together.
    """
    lengths = np.array([len(e) for e, _ in batch])
    states = [extended(labels, blank) for _, labels in batch]
    width, longest = max(map(len, states)), int(lengths.max())
    steps = np.full((len(batch), longest, width), -np.inf)
    for i, ((e, _), s) in enumerate(zip(batch, states, strict=True)):
        steps[i, : len(e), : len(s)] = e[:, s]
    best = np.full((len(batch), width), -np.inf)
    best[:, :2] = steps[:, 0, :2]
    moved = np.zeros((len(batch), longest, width), bool)
    scores = [best]
    for t in range(1, longest):
        before = np.concatenate([np.full((len(batch), 1), -np.inf), best[:, :-1]], axis=1)
        moved[:, t] = before > best
        best = np.where(moved[:, t], before, best) + steps[:, t]
        scores.append(best)
    out = []
    for i, s in enumerate(states):
        n, last = int(lengths[i]), len(s) - 1
        end = scores[n - 1][i]
        m = last - 1 if last and end[last - 1] > end[last] else last
        path = np.empty(n, np.int64)
        for t in range(n - 1, -1, -1):
            path[t] = m
            m -= int(moved[i, t, m])
        out.append(path)
    return out


def confidence(e: np.ndarray, label: int, blank: int, rivals: list[int], role: Role) -> float:
    """Confidence from 0 to 1 of one unit over its frames (log probabilities)."""
    if len(e) >= 3:
        e = e[int(role.tail * len(e)) :]
    lead = np.exp(e[:, label]) - np.exp(e[:, blank])
    if (lead >= role.delta).any():
        e = e[lead >= role.delta]
    if len(e) > 1 and role.top < 1:
        e = e[np.argsort(-e[:, label], kind="stable")[: max(1, int(np.ceil(role.top * len(e))))]]
    if not rivals:
        p, q = np.exp(e[:, label]), np.exp(e[:, blank])
        return max(role.floor, float((p / np.maximum(p + q, 1e-300)).mean()))
    others = -np.sort(-e[:, rivals], axis=1)[:, : role.rivals]
    margin = np.sort(e[:, label] - np.logaddexp.reduce(others, axis=1))[::-1]
    margin = margin[: max(1, int(np.ceil(role.pool * len(margin))))]
    mean = float((1 / (1 + np.exp(np.clip(-margin / role.width, -700, 700)))).mean())
    return max(role.floor, min(1.0, max(0.02, (mean - role.bias) / (1 - role.bias))) ** role.power)


def _forced(blank: int, classes: dict[int, str], roles: dict[str, Role]):
    def units(number: int, e: np.ndarray, labels: list[int], kinds: list[str], path: np.ndarray) -> Iterator[tuple]:
        for i, label in enumerate(labels):
            at = np.flatnonzero(path == 2 * i + 1)
            n = len(at)
            if not n:  # never visited (fewer frames than states): its best frame stands for it
                at = np.array([int(e[:, label].argmax())])
            rivals = [x for x, c in classes.items() if c == classes.get(label) and x not in (label, blank)]
            yield number, i, label, int(at[0]), int(at[-1]), n, confidence(e[at], label, blank, rivals, roles.get(kinds[i], Role()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["_key"]
            rows = [(i, np.array(e, np.float64), labels, kinds) for i, (e, labels, kinds) in enumerate(zip(batch["e"].to_pylist(), batch["labels"].to_pylist(), batch["roles"].to_pylist(), strict=True)) if e and labels]
            rows.sort(key=lambda r: (len(r[1]), len(r[2])))  # neighbours of one length make full batches
            at = 0
            while at < len(rows):
                end, cells = at + 1, 0
                while end < len(rows) and (end + 1 - at) * len(rows[end][1]) * (2 * max(len(r[2]) for r in rows[at : end + 1]) + 1) <= CELLS:
                    end += 1
                part = rows[at:end]
                paths = forced_paths([(e, labels) for _, e, labels, _ in part], blank)
                made = [x for (i, e, labels, kinds), path in zip(part, paths, strict=True) for x in units(i, e, labels, kinds or [""] * len(labels), path)]
                columns = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0])), *(pa.array(x, pa.int64()) for x in columns[1:6]), pa.array(columns[6], pa.float64())], ["_key", "unit", "label", "first_frame", "last_frame", "n_frames", "confidence"])
                at = end

    return run


def forced_confidences(frames: DataFrame, refs: DataFrame, key: list[str], blank: int, classes: dict[int, str], roles: dict[str, Role] | None = None) -> DataFrame:
    """Units of each utterance with their frames and confidence (K9).

    ``frames`` has the key, ``t`` and ``e`` (log probability of each label), ``refs`` the key, ``labels`` and ``roles`` of the units
    (null: none). Frames of an utterance are put together, so it must fit a task, as speech does. A unit that the path can't
    reach has no frames and is judged by its best one. Utterances without frames or labels have no rows. Rivals are the
    labels of a unit's class.
    """
    one = frames.groupBy(F.struct(*key).alias("_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "e"))), lambda x: x["e"]).alias("e"))
    both = one.join(refs.select(F.struct(*key).alias("_key"), "labels", "roles"), "_key")
    kind = both.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, unit long, label long, first_frame long, last_frame long, n_frames long, confidence double"
    return both.mapInArrow(_forced(blank, classes, roles or {}), schema).select("_key.*", "unit", "label", "first_frame", "last_frame", "n_frames", "confidence")


class _Monotonic:
    """The best monotonic path over rows given one by one: the sums of the last row, and a byte a cell for its step."""

    def __init__(self, width: int):
        self.width, self.rows, self.moved = width, 0, bytearray()
        self.best, self.before = np.full(width, -np.inf), np.full(width, -np.inf)

    def add(self, v: np.ndarray) -> None:
        y, self.before[1:] = self.rows, self.best[:-1]
        moved = self.before > self.best
        if y < self.width:  # the diagonal comes from the one above it
            moved[y] = y > 0
        self.best = (np.fmax(self.best, self.before) if y else np.where(np.arange(self.width) == 0, 0.0, -np.inf)) + v
        self.moved += moved.tobytes()
        self.rows += 1

    def path(self) -> np.ndarray | None:
        if not 0 < self.width <= self.rows:
            return None
        out, x, w, moved = np.empty(self.rows, np.int32), self.width - 1, self.width, self.moved
        for y in range(self.rows - 1, -1, -1):
            out[y] = x
            x -= moved[y * w + x]
        return out


def monotonic_path(values: Column) -> Column:
    """Column of each row of a matrix (rows x columns, as many rows as columns at least) on the best monotonic path.

    The path begins in the first column, stays or goes on by one in every row, and ends in the last; ties stay. A matrix is
    one value here; ``monotonic_paths`` takes its rows as rows.
    """

    def run(matrices: pd.Series) -> pd.Series:
        out = []
        for m in matrices:
            lines = _Monotonic(len(m[0]) if m is not None and len(m) else 0)
            for v in m if lines.width else ():
                lines.add(np.asarray(v, np.float64))
            out.append(lines.path())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<int>")(values)


def _monotonic(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        paths: list[np.ndarray] = []
        lines, own, held = _Monotonic(0), None, 0

        def end() -> None:
            path = lines.path()
            if path is not None:
                keys.append(own)
                paths.append(path)

        def made() -> Iterator[pa.RecordBatch]:
            of = pa.concat_arrays(keys)
            which, x = np.repeat(np.arange(len(paths)), [len(p) for p in paths]), np.concatenate(paths)
            y = np.concatenate([np.arange(len(p), dtype=np.int32) for p in paths])
            for a in range(0, len(x), ROWS):
                yield pa.RecordBatch.from_arrays([of.take(pa.array(which[a : a + ROWS])), pa.array(y[a : a + ROWS]), pa.array(x[a : a + ROWS])], [key, "y", "x"])
            keys.clear()
            paths.clear()

        for batch in batches:
            flat, offsets = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64), batch["v"].value_lengths().fill_null(0).to_numpy()
            offsets = np.r_[0, np.cumsum(offsets)].tolist()
            for i, y in enumerate(batch["y"].to_pylist()):
                if y == 0:
                    end()
                    held += lines.rows
                    if held > ROWS and paths:
                        yield from made()
                        held = 0
                    lines, own = _Monotonic(offsets[i + 1] - offsets[i]), batch[key].slice(i, 1)
                lines.add(flat[offsets[i] : offsets[i + 1]])
        end()
        if paths:
            yield from made()

    return run


def monotonic_paths(rows: DataFrame, key: list[str]) -> DataFrame:
    """The place ``x`` of each row (key, y, v: values of one length within a key) on the best monotonic path of its key.

    Rows are numbered by ``y`` from 0. As ``monotonic_path``, but rows of a key stream through a task in their order, which
    holds a byte for each value of one key. Keys with fewer rows than values a row have no path.
    """
    one = rows.select(F.struct(*key).alias("_key"), F.col("y").cast("int").alias("y"), F.col("v").cast("array<double>").alias("v"))
    dealt = one.repartition("_key").sortWithinPartitions("_key", "y")
    return dealt.mapInArrow(_monotonic("_key"), f"_key {one.schema['_key'].dataType.simpleString()}, y int, x int").select("_key.*", "y", "x")
