"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

The automaton of all items' words streams the words of every text and keeps the length of the longest match that ends
at each word. A match of ``window`` words or more marks these words; an item of fewer words counts as one window.
Marked runs are removed where they exceed a limit of length or of coverage. Items are dealt into shards of at most
``shard_words`` words. Only one shard's words are ever broadcast, so what is broadcast has a fixed bound; with more items
the texts, with what is marked so far, are written and streamed again for each further shard. Nothing is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import WORD, ascii_lower, discard, materialise, text_source, texts

#: Words of an item that must stand together in a text.
WINDOW = 13
#: Most words of items in one automaton (about 150 bytes of a worker's memory each, times the states).
SHARD_WORDS = 200_000

#: For UTF-8 bytes: A-Z to a-z, all that stands in no word to a space.
_PLAIN = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, as UTF-8 bytes."""
    return text.translate(_PLAIN).split()


class Automaton:
    """Suffix automaton of several word sequences; states are numbers, words are UTF-8 bytes."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.window = window
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # The state of the last ``window`` words of a match that ends in a state: once for each, shorter states first.
        by_length = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        self.at_window = list(range(len(self.len)))
        for state in by_length:
            if self.len[self.link[state]] >= window:
                self.at_window[state] = self.at_window[self.link[state]]
        # Items of each state in which a match of a whole window can end, and short items by their last state.
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, tuple[int, set[int]]] = {}
        for item, words in items:
            if 0 < len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][w]
                self.short.setdefault(state, (len(words), set()))[1].add(item)
            state, length = 0, 0
            for w in words:
                state, length = self.step(state, length, w)
                if length >= window:
                    self.items.setdefault(self.at_window[state], set()).add(item)
        self.known = self.next[0].__contains__
        self.run = b"\1" * min([window, *(len(words) for _, words in items)])
        self.shorts: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        for state in by_length:
            own = ((self.short[state][0], state),) if state in self.short else ()
            self.shorts[state] = self.shorts[self.link[state]] + own

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        new = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: bytes) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def step(self, state: int, length: int, w: bytes) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, length + 1)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs of marked words (start, end), and the items whose windows occur."""
        nxt, link, length, window, shorts, at_window = self.next, self.link, self.len, self.window, self.shorts, self.at_window
        spans: list[list[int]] = []
        ends: set[int] = set()
        if self.run not in bytes(map(self.known, words)):  # no run of known words long enough for a window
            return [], set()
        state, n = 0, 0
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            if to is None:
                if state == 0:
                    continue
                while state and w not in nxt[state]:
                    state = link[state]
                    n = length[state]
                to = nxt[state].get(w)
                if to is None:
                    n = 0
                    continue
            state, n = to, n + 1
            least = 0
            if n >= window:
                least = window
                ends.add(at_window[state])
            for size, last in shorts[state]:
                if size <= n:
                    least = max(least, size)
                    ends.add(-last)
            if least:
                a = i + 1 - least
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append([a, i + 1])
        found: set[int] = set()
        return [tuple(x) for x in spans], found.union(*(self.items[e] if e > 0 else self.short[-e][1] for e in ends))


_built: dict[str, Automaton] = {}


def _automaton(name: str, items: list[tuple[int, list[bytes]]], window: int) -> Automaton:
    """One automaton a worker; the last one only."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(items, window)
    return _built[name]


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that touch or overlap as one, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_RUN = re.compile(rb"[^ ]+")
_LONGS = pa.list_(pa.int64())
_MARKS = StructType([StructField("n_words", LongType()), *(StructField(c, ArrayType(LongType())) for c in ("starts", "ends", "from_bytes", "to_bytes", "items"))])


def _stream(name: str, items, window: int, carried: list[str]):
    """Marks of earlier shards, where the batches have them, and those of this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(name, items.value, window)
        for batch in batches:
            before = list(zip(*(batch[c].to_pylist() for c in ("starts", "ends", "items")), strict=True)) if "starts" in batch.schema.names else [([], [], [])] * batch.num_rows
            n, runs, places, found = [], [], [], []
            for raw, (starts, ends, known) in zip(texts(batch), before, strict=True):
                words = words_of(raw)
                spans, items_ = machine.matches(words)
                spans = _union([*spans, *zip(starts, ends, strict=True)]) if starts else spans
                at = [m.span() for m in _RUN.finditer(raw.translate(_PLAIN))] if spans else []
                n.append(len(words))
                runs.append(spans)
                places.append([(at[a][0], at[b - 1][1]) for a, b in spans])
                found.append(sorted(items_.union(known)))
            lists = [pa.array([[x[k] for x in row] for row in rows], _LONGS) for rows in (runs, places) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), pa.array(n, pa.int64()), *lists, pa.array(found, _LONGS)], [*carried, *_MARKS.names])

    return run


def item_shards(items: DataFrame, shard_words: int = SHARD_WORDS) -> list[DataFrame]:
    """(item_id, words) in shards of about ``shard_words`` words by a hash of the item."""
    words = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.regexp_extract_all(ascii_lower("text"), F.lit(WORD), F.lit(0)).alias("words")).where(F.size("words") > 0)
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-total * 5 // (4 * shard_words))) if total > shard_words else 1
    return [words.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(shards)) == k) for k in range(shards)]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_words, starts, ends, from_bytes, to_bytes, items)`` of each row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    ``starts`` and ``ends`` are the maximal runs of words inside any occurrence of a window, ``from_bytes`` and
    ``to_bytes`` their places in the UTF-8 text, ``items`` the items with such windows, ascending. Words are lower-cased
    (A-Z) runs of letters, digits and characters beyond ASCII. Null and empty texts have no words; items without words
    are nothing; rows of one item_id count as one item. Rows without a doc_id are left out, repeated rows give a row
    each. Columns of ``carry`` come along in a struct ``carried``. Empty tables give no rows, or rows without matches.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *text_source(carry))
    kept = [c for c in rows.columns if c != "text"]
    kinds = {f.name: f for f in rows.schema}
    shards, written = item_shards(items, shard_words), None
    for k, shard in enumerate(shards):
        held = [(r["item_id"], [w.encode() for w in r["words"]]) for r in shard.orderBy("item_id").toLocalIterator()]
        names = kept if k + 1 == len(shards) else [c for c in (*kept, "text") if c in kinds]
        rows = rows.mapInArrow(_stream(uuid.uuid4().hex, spark.sparkContext.broadcast(held), window, names), StructType([*(kinds[c] for c in names), *_MARKS]))
        if k + 1 < len(shards):
            before, written = written, materialise(rows)
            rows = written
            if before is not None:
                discard(before)
    return rows


def judged(found: DataFrame, min_share: float = 0.05) -> DataFrame:
    """Adds ``n_hit`` (marked words) and ``contaminated`` (some, and at least ``min_share`` of all words; compared in millionths)."""
    hit = F.aggregate(F.zip_with("ends", "starts", lambda a, b: a - b), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (1_000_000 * F.col("n_hit") >= round(1_000_000 * min_share) * F.col("n_words")))


def without_spans(docs: DataFrame, items: DataFrame, max_words: int, max_share: float = 0.05, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(carried, contaminated, n_cut, kept_text)`` of each row of ``docs`` with a doc_id; ``carried`` holds its columns.

    ``kept_text`` lacks the marked runs of more than ``max_words`` words and, where a text is contaminated (coverage of at
    least ``max_share``), all marked runs; ``n_cut`` counts them. What stands on both sides of a run is joined by one space.
    A null text stays null, others are kept byte for byte where nothing is cut.
    """
    found = judged(contamination(docs, items, window, shard_words, carry=tuple(docs.columns)), max_share)
    runs = F.filter(F.arrays_zip("starts", "ends", "from_bytes", "to_bytes"), lambda x: F.col("contaminated") | (x["ends"] - x["starts"] > max_words))
    found = found.withColumn("runs", runs)
    raw = F.col("carried.text").cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.col("runs.to_bytes"))
    stops = F.concat(F.col("runs.from_bytes"), F.array(F.octet_length(raw).cast("long")))
    parts = F.zip_with(begins, stops, lambda a, b: F.substr(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    text = F.when(F.size("runs") > 0, F.array_join(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != ""), " ")).otherwise(F.col("carried.text"))
    return found.select("carried", "contaminated", F.size("runs").alias("n_cut"), text.alias("kept_text"))
