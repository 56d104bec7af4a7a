"""State machines over the ordered rows of keys of any size (E6, E8, E14): speculate, then repair.

Rows lie in ranges of (key, order). All ranges run at once, each from a fresh state; then only those whose key goes on
from the range before run again, from the state in which that one ended, until no state changes. A machine soon forgets
where it began (the next text kept, the next silence), so a few rounds do; the result is that of one walk in any case.
A task holds a machine's state and a batch, and no more than two keys of a range need any repair.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import discard, shared_table
from .scans import ordered
from .state import count_similarity


class Machine:
    """``feed`` takes a row and gives what goes out; ``end`` what is left at the end of a key; ``state`` is all that it knows."""

    state: object = None

    def feed(self, *row) -> Iterator[tuple]:
        raise NotImplementedError

    def end(self) -> Iterator[tuple]:
        return iter(())


class UnlikeLastKept(Machine):
    """Ids of rows (id, text) that aren't like the last one kept (E14); null texts are empty, and empty ones like nothing."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def feed(self, name: int, text: str | None) -> Iterator[tuple]:
        if self.state is None or count_similarity(self.state, text or "") < self.threshold:
            self.state = text or ""
            yield (name,)


class Hysteresis(Machine):
    """Regions (start, end) of boolean frames: open after enough voiced ones, close after enough others, both dated back."""

    state = (0, None, 0, None)

    def __init__(self, frame_ms: int = 10, start_ms: int = 30, end_ms: int = 100, pad_ms: int = 0, least_ms: int = 0):
        self.frame, self.need, self.stop, self.pad, self.least = frame_ms, max(1, start_ms // frame_ms), max(1, end_ms // frame_ms), pad_ms, least_ms

    def _region(self, a: int, b: int) -> Iterator[tuple]:
        start, end = max(0, a * self.frame - self.pad), b * self.frame + self.pad
        if end - start >= self.least:
            yield start, end

    def feed(self, voiced: bool) -> Iterator[tuple]:
        i, open_at, run, last = self.state
        run = run + 1 if voiced == last else 1
        if open_at is None and voiced and run >= self.need:
            open_at = i - run + 1
        elif open_at is not None and not voiced and run >= self.stop:
            yield from self._region(open_at, i - run + 1)
            open_at = None
        self.state = (i + 1, open_at, run, voiced)

    def end(self) -> Iterator[tuple]:
        i, open_at, _, _ = self.state
        if open_at is not None:
            yield from self._region(open_at, i)


class Packs(Machine):
    """Adjacent intervals (start, end, silent) joined until a target; silence closes a pack."""

    def __init__(self, target: int, least: int, most: int):
        self.target, self.least, self.most = target, least, most

    def _parts(self) -> Iterator[tuple]:
        a, b = self.state
        self.state = None
        if b - a >= self.least:
            while b - a > self.most:
                yield a, a + self.most
                a += self.most
            if b - a >= self.least:
                yield a, b

    def feed(self, start: int, end: int, silent: bool) -> Iterator[tuple]:
        if silent:
            if self.state:
                yield from self._parts()
            return
        self.state = (self.state[0] if self.state else start, end)
        if end - self.state[0] >= self.target:
            yield from self._parts()

    def end(self) -> Iterator[tuple]:
        if self.state:
            yield from self._parts()


def _walk(machine: Callable[[], Machine], columns: list[str], outputs: list[str] | None):
    """Rows of segments in order, each behind the row of its state; gives outputs, or with None the states at the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds: dict[str, pa.DataType] = {}
        at, now, last = None, None, False

        def close() -> None:
            if at is None:
                return
            if outputs is None:
                out.append((*at, pickle.dumps(now.state)))
            elif last:
                out.extend((at[1], *x) for x in now.end())

        def flush() -> pa.RecordBatch:
            names = ["_part", "_key", "state"] if outputs is None else ["_key", *outputs]
            types = {"_part": pa.int32(), "_key": kinds["_key"], "state": pa.binary()}
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], types.get(n, pa.int64())) for i, n in enumerate(names)], names)
            out.clear()
            return made

        for batch in batches:
            kinds["_key"] = batch["_key"].type
            for part, key, state, final, *row in zip(*(batch[c].to_pylist() for c in ("_part", "_key", "state", "final", *columns)), strict=True):
                if final is not None:  # a segment begins
                    close()
                    at, now, last = (part, key), machine(), final
                    if state is not None:
                        now.state = pickle.loads(state)
                    continue
                made = now.feed(*row)
                if outputs is None:
                    for _ in made:
                        pass
                else:
                    out.extend((key, *x) for x in made)
            if len(out) > 4096:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def machine_over_keys(rows: DataFrame, key: list[str], order: list[str], machine: Callable[[], Machine], columns: list[str], outputs: list[str]) -> DataFrame:
    """``outputs`` (longs) of a ``machine`` fed with ``columns`` of each key's rows in order; a null key is a key."""
    held = ordered(rows.select(*key, *dict.fromkeys(c for c in (*order, *columns) if c not in key)), key, order)
    over = W.partitionBy("_key").orderBy("_part")
    segments = held.select("_part", "_key").distinct()
    segments = shared_table(segments.withColumn("before", F.lag("_part").over(over)).withColumn("final", F.lead("_part").over(over).isNull()))
    given = [F.col(c) for c in columns]

    def walked(heads: DataFrame, outs: list[str] | None, only: DataFrame | None = None) -> DataFrame:
        body = held if only is None else held.join(only.select("_part", "_key"), ["_part", "_key"], "left_semi")
        body = body.select("_part", "_key", "_n", F.lit(None).cast("binary").alias("state"), F.lit(None).cast("boolean").alias("final"), *given)
        head = heads.select("_part", "_key", F.lit(-1).cast("long").alias("_n"), "state", "final")
        # A part is one task; its state rows stand before the rows of their keys.
        both = body.unionByName(head, allowMissingColumns=True).repartition("_part").sortWithinPartitions("_part", "_key", "_n")
        kind = held.schema["_key"].dataType.simpleString()
        schema = f"_part int, _key {kind}, state binary" if outs is None else ", ".join([f"_key {kind}", *(f"{o} long" for o in outs)])
        return both.mapInArrow(_walk(machine, columns, outs), schema)

    broken = segments.where(F.col("before").isNotNull() | ~F.col("final"))
    states = segments.withColumn("state", F.lit(None).cast("binary"))
    if not broken.isEmpty():
        todo = broken.withColumn("state", F.lit(None).cast("binary"))
        ends = shared_table(walked(todo, None, todo).withColumnRenamed("state", "out"))
        came = shared_table(todo)
        while True:
            # What each segment should have begun with, and which of them began otherwise.
            true = came.join(ends.select(F.col("_part").alias("before"), "_key", F.col("out").alias("new")), ["before", "_key"], "left").select("_part", "_key", "before", "final", "state", "new")
            wrong = shared_table(true.where(~F.col("new").eqNullSafe(F.col("state"))).select("_part", "_key", "before", "final", F.col("new").alias("state")))
            if wrong.isEmpty():
                discard(wrong)
                break
            fixed = walked(wrong, None, wrong).withColumnRenamed("state", "out")
            old = (ends, came)
            ends = shared_table(ends.join(wrong, ["_part", "_key"], "left_anti").unionByName(fixed))
            came = shared_table(came.join(wrong, ["_part", "_key"], "left_anti").unionByName(wrong.select(*came.columns)))
            discard(*old, wrong)
        states = segments.join(came.select("_part", "_key", "state"), ["_part", "_key"], "left")
    return walked(states, outputs).select("_key.*", *outputs)
