"""State machines over ordered rows whose next step depends on what they put out.

Each runs once for every key on its rows in order: those over utterances, bounded by their length, on lists
(``per_key``); those over streams of any length as generators that hold their own state only (``per_key_streamed``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from math import sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_key(rows: DataFrame, key: str, order: list[str], step: Callable[[list[tuple]], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """``step`` over the tuples of ``columns`` of each key in order; its results under the key."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = step(list(pdf.sort_values(order)[columns].itertuples(index=False, name=None)))
        out = pd.DataFrame(made, columns=names)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *dict.fromkeys([*order, *columns])).groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def per_key_streamed(rows: DataFrame, key: str, order: list[str], step: Callable[[Iterator[tuple]], Iterator[tuple]], columns: list[str], schema: str) -> DataFrame:
    """As ``per_key``, but ``step`` reads and gives the rows of a key one by one: a task holds a batch, whatever a key's size."""
    kind = rows.schema[key].dataType.simpleString()
    fields = f"{key} {kind}, {schema}"
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def flat() -> Iterator[tuple]:
            for batch in batches:
                if not kinds:
                    kinds.extend([batch[key].type] + [pa.int64()] * (len(names) - 1))
                yield from zip(*(batch[c].to_pylist() for c in (key, *columns)), strict=True)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        out: list[tuple] = []
        for k, group in groupby(flat(), key=lambda r: r[0]):
            for made in step(r[1:] for r in group):
                out.append((k, *made))
                if len(out) == 4096:
                    yield flush()
        if out:
            yield flush()

    if any(x.split()[1] != "long" for x in schema.split(", ")):
        raise ValueError("results are longs")
    sorted_ = rows.select(key, *dict.fromkeys([*order, *columns])).repartition(key).sortWithinPartitions(key, *(F.col(o).asc_nulls_last() for o in order))
    return sorted_.select(key, *columns).mapInArrow(run, fields)


def hysteresis(frames: Iterable[tuple], frame_ms: int = 10, start_ms: int = 30, end_ms: int = 100, pad_ms: int = 0, least_ms: int = 0) -> list[tuple]:
    return list(hysteresis_steps(frames, frame_ms, start_ms, end_ms, pad_ms, least_ms))


def hysteresis_steps(frames: Iterable[tuple], frame_ms: int = 10, start_ms: int = 30, end_ms: int = 100, pad_ms: int = 0, least_ms: int = 0) -> Iterator[tuple]:
    """Speech regions (start, end) of boolean frames: open after enough voiced frames, close after enough others, both dated back."""
    need, stop = max(1, start_ms // frame_ms), max(1, end_ms // frame_ms)
    open_at, run, last, n = None, 0, None, 0

    def span(a: int, b: int) -> Iterator[tuple]:
        s = (max(0, a * frame_ms - pad_ms), b * frame_ms + pad_ms)
        if s[1] - s[0] >= least_ms:
            yield s

    for i, (voiced,) in enumerate(frames):
        n = i + 1
        run, last = (run + 1 if voiced == last else 1), voiced
        if open_at is None and voiced and run >= need:
            open_at = i - run + 1
        elif open_at is not None and not voiced and run >= stop:
            yield from span(open_at, i - run + 1)
            open_at = None
    if open_at is not None:
        yield from span(open_at, n)


def pack_to_target(intervals: Iterable[tuple], target: int, least: int, most: int, words: list[tuple] = ()) -> list[tuple]:
    return list(pack_to_target_steps(intervals, target, least, most, words))


def pack_to_target_steps(intervals: Iterable[tuple], target: int, least: int, most: int, words: list[tuple] = ()) -> Iterator[tuple]:
    """Adjacent intervals (start, end, silent) joined until a target; silence closes a pack, so does leaving a word."""
    within = lambda a, b: not words or any(s <= a and b <= e for s, e in words)

    def packs() -> Iterator[tuple]:
        cur = None
        for start, end, silent in intervals:
            if silent:
                if cur:
                    yield cur
                cur = None
                continue
            if cur and not within(cur[0], end):
                yield cur
                cur = None
            cur = (cur[0] if cur else start, end)
            if cur[1] - cur[0] >= target:
                yield cur
                cur = None
        if cur:
            yield cur

    none = True
    for a, b in packs():
        if b - a < least:
            continue
        while b - a > most:
            yield a, a + most
            none = False
            a += most
        if b - a >= least or (b - a and none):
            yield a, b
            none = False


def splice(phones: list[tuple], least: int, most: int, is_vowel: Callable[[str], bool]) -> list[tuple]:
    """Half-open runs (i, j) of phones (start, end, label) up to a length, cut back to a vowel after a consonant."""
    out, i, n = [], 0, len(phones)
    while i < n:
        j = i
        while j < n and phones[j][1] - phones[i][0] < most:
            j += 1
        for k in range(min(j, n - 1), i + 1, -1):
            if is_vowel(phones[k][2]) and not is_vowel(phones[k - 1][2]):
                j = k
                break
        j = max(j, i + 1)
        while j < n and phones[j - 1][1] - phones[i][0] < least:
            j += 1
        out.append((i, j))
        i = j
    return out


def phone_groups(phones: list[tuple], least: int, most: int, fewest: int, stride: int = 1) -> list[tuple]:
    """Overlapping groups (i, j) of phones (start, end) between two lengths."""
    out, n = [], len(phones)
    for i in range(0, n, stride):
        j = i + 1
        while j < n and (phones[j - 1][1] - phones[i][0] < least or j - i < fewest):
            j += 1
        while j - 1 > i and phones[j - 1][1] - phones[i][0] > most:
            j -= 1
        if least <= phones[j - 1][1] - phones[i][0] <= most and j - i >= fewest:
            out.append((i, j))
    return out


def compose_units(words: list[tuple], most: int = 2) -> list[tuple]:
    """Units of at most ``most`` syllables from one or two words (text, syllables), longer words passed over."""
    out, i = [], 0
    while i < len(words):
        if words[i][1] <= most:
            if i + 1 < len(words) and words[i][1] + words[i + 1][1] <= most:
                out.append((words[i][0] + " " + words[i + 1][0], words[i][1] + words[i + 1][1]))
                i += 2
                continue
            out.append((words[i][0], words[i][1]))
        i += 1
    return out


def count_similarity(a: str, b: str) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    dot = sum(n * y[w] for w, n in x.items())
    return dot / sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values())) if x and y else 0.0


def unlike_last_kept(rows: Iterable[tuple], threshold: float) -> list[tuple]:
    return list(unlike_last_kept_steps(rows, threshold))


def unlike_last_kept_steps(rows: Iterable[tuple], threshold: float) -> Iterator[tuple]:
    """Rows (id, text) that aren't like the last one kept."""
    last = None
    for i, text in rows:
        if last is None or count_similarity(last, text or "") < threshold:
            yield (i,)
            last = text or ""


def merge_pairs(rows: list[tuple], pairs: dict[tuple[str, str], str]) -> list[tuple]:
    """Neighbouring labels (label, score) that make one, merged with their mean score; both are used up."""
    out, i = [], 0
    while i < len(rows):
        both = pairs.get((rows[i][0], rows[i + 1][0])) if i + 1 < len(rows) else None
        out.append((both, (rows[i][1] + rows[i + 1][1]) / 2) if both else rows[i])
        i += 2 if both else 1
    return out


def by_nuclei(phones: list[tuple], expected: list[int], is_vowel: Callable[[str], bool]) -> list[tuple]:
    """Segments (i, j) of phones (label) with the expected numbers of vowels; consonants before the next vowel go with it."""
    out, i, n = [], 0, len(phones)
    for part, want in enumerate(expected):
        j, seen = i, 0
        while j < n and seen < want:
            seen += is_vowel(phones[j][0])
            j += 1
        last = part == len(expected) - 1
        while j < n and not is_vowel(phones[j][0]) and (last or (j + 1 < n and not is_vowel(phones[j + 1][0]))):
            j += 1
        out.append((i, n if last else j))
        i = j
    return out
