"""Packing of token pieces into sequences under several limits at once (vector bin packing by dot product).

A sequence holds at most ``max_tokens`` tokens, ``max_segments`` pieces and ``max_loss`` loss-bearing tokens. Among a
bounded set of open pieces, the one with the largest dot product of its demands and the sequence's free room (each as a
share of its limit) that fits goes next; if none fits, the best is cut to what fits, so that a sequence is left before
it is full only when its segments or loss tokens are used up. Every task packs the rows of its own partition, in their
order and in bounded memory, so there is no shuffle, and a lost task packs the same rows into the same sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Limits of a sequence.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 256, 2048
#: Open pieces that a task looks at; memory is bounded by it.
LOOK = 16
#: Ends a document.
END = 1
#: Entries of each of a worker's two tables of known words: those of late, and those of the time before.
KNOWN = 80_000

#: Words that byte-level BPE never joins, for texts of ASCII and Latin letters only.
_LATIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
#: Anything beyond printable ASCII, tab, newline and these letters takes the general expression.
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ɏ]")


def ranked(path: str) -> tiktoken.Encoding:
    """A byte-level BPE file whose merges are in the order of their ids, for single words in microseconds."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict(zip(map(chr, plain), plain, strict=True)) | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, bytes]:
    """Ids of a tokenizer file's added tokens, as bytes, by their strings."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that look at their surroundings are not supported")
    return {t["content"]: array("I", [t["id"]]).tobytes() for t in added}


class Encoder:
    """Ids of texts by a tokenizer file, as bytes of little-endian 32-bit numbers; remembers words it has seen.

    With ``special``, strings of the file's added tokens give their ids, else they are ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        self.encode = ranked(path).encode_ordinary
        self.added = added_tokens(path) if special else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.any = regex.compile(public_tokenizers.PATTERN)
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not any(s in text for s in self.added):
            return self.plain(text)
        return b"".join(self.added[p] if p in self.added else self.plain(p) for p in self.cut.split(text))

    def plain(self, text: str) -> bytes:
        words = (self.any if _OTHER.search(text) else _LATIN).findall(text)
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > KNOWN:
            self.before, self.words = known, {}
            known = self.words
        before = self.before
        for w in set(words).difference(known):
            known[w] = before.get(w) or array("I", self.encode(w)).tobytes()
        return b"".join([known[w] for w in words])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = False) -> Encoder:
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]


class Piece:
    __slots__ = ("at", "doc", "ids", "left", "loss", "loss_from", "tokens")

    def __init__(self, doc: int, ids: bytes, loss_from: int):
        self.doc, self.ids, self.tokens, self.at = doc, ids, len(ids) // 4, 0
        self.left, self.loss_from = self.tokens, loss_from
        self.loss = max(0, self.tokens - loss_from)


def pack(pieces: Iterator[Piece], max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, look: int = LOOK) -> Iterator[tuple[Piece, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of pieces; sequences count from 0.

    Tokens of a document from ``loss_from`` on bear loss.
    """
    open_: deque[Piece] = deque()
    sequence, ended = 0, False
    tokens, segments, loss = max_tokens, max_segments, max_loss
    while True:
        while len(open_) < look and not ended:
            one = next(pieces, None)
            if one is None:
                ended = True
            elif one.left:
                open_.append(one)
        if not open_:
            return
        if segments == 0 or tokens == 0:
            sequence += 1
            tokens, segments, loss = max_tokens, max_segments, max_loss
        best, score, whole = None, -1.0, False
        free_t, free_l, free_s = tokens / max_tokens / max_tokens, loss / max_loss / max_loss, segments / max_segments / max_segments
        for p in open_:
            fits = p.left <= tokens and p.loss <= loss
            if whole and not fits:
                continue
            s = p.left * free_t + p.loss * free_l + free_s
            if (fits and not whole) or s > score:
                best, score, whole = p, s, fits
        take = best.left
        if not whole:
            free_of_loss = max(0, best.loss_from - best.at)
            take = min(best.left, tokens, free_of_loss + loss)
            if take <= 0:  # nothing of it may go here
                sequence += 1
                tokens, segments, loss = max_tokens, max_segments, max_loss
                continue
        borne = max(0, best.at + take - max(best.at, best.loss_from))
        yield best, best.at, take, sequence, max_tokens - tokens
        best.at += take
        best.left -= take
        best.loss -= borne
        tokens, segments, loss = tokens - take, segments - 1, loss - borne
        if not best.left:
            open_.remove(best)


_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


def _pack_batches(path: str, limits: tuple[int, int, int], look: int, with_ids: bool, special: bool):
    end = np.array([END], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        ids_of = encoder(path, special)
        for batch in batches:
            froms, prompts = batch["loss_from"].to_pylist(), batch["prompt"].to_pylist()
            for doc, text, loss_from, prompt in zip(batch["doc_id"].to_pylist(), batch["text"], froms, prompts, strict=True):
                yield Piece(doc, ids_of(str(text.as_buffer(), "utf-8")) + end, len(ids_of(prompt)) // 4 if prompt else loss_from or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [pa.int64()] * 8 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FIELDS.split(", ")])

        for p, start, length, sequence, offset in pack(pieces(batches), *limits, look):
            part = p.ids[4 * start : 4 * (start + length)]
            borne = max(0, start + length - max(start, p.loss_from))
            rows.append((p.doc, start, length, zlib.crc32(part), p.tokens, base + sequence, offset, borne, part if with_ids else None))
            if len(rows) == 1024:
                yield flush()
        if rows:
            yield flush()

    return run


def first_line(text: str = "text") -> Column:
    """The first line of a text of several lines, with its end; null for others."""
    line = F.substring_index(text, "\n", 1)
    return F.when(F.col(text).contains("\n"), F.concat(line, F.lit("\n")))


def packed(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, look: int = LOOK, loss_from: str | None = None, prompt: Column | None = None, with_ids: bool = True, special: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, ids.

    Every row of ``docs`` (doc_id, text; others are ignored) gives the ids of its text by the ``tokenizer`` file and id 1;
    a null or empty text gives id 1 alone. ``loss_from`` names a column with the number of leading tokens that bear no
    loss (null: none), or ``prompt`` is the leading text that bears none, as many tokens as it has by itself. Repeated rows are packed each. Sequence ids are the task's number shifted by 32 bits plus a count;
    they have gaps between tasks. With ``special``, strings of the file's added tokens give their ids, as
    ``tokenizers`` does with that file; else they are ordinary text. Each task leaves at most its last sequence short of tokens for want of rows. An empty
    table gives no rows.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), (F.col(loss_from).cast("long") if loss_from else F.lit(0).cast("long")).alias("loss_from"), (F.lit(None) if prompt is None else prompt).cast("string").alias("prompt"))
    return rows.mapInArrow(_pack_batches(path, (max_tokens, max_segments, max_loss), look, with_ids, special), _FIELDS)
