"""Removal of repeated byte strings: all but the first occurrence of every string of ``length`` bytes.

Two equal strings of ``length`` bytes choose the same k-gram inside (the one with the least hash), so it is enough to
bring together the stretches that share a chosen k-gram:

1. documents are dealt into blocks; a block names the k-grams that its strings choose, each once;
2. k-grams that several blocks name (or one block has in different surroundings) are reported back to these blocks;
3. a block cuts the stretch around each reported k-gram, keeps the first of equal stretches and sends it to the bucket
   of its k-gram. A k-gram with very many different stretches is split: each of its strings goes to a bucket by its own
   content, so that no bucket grows with one k-gram;
4. a bucket keeps the first of equal stretches, sorts the suffixes of the rest in two stages and reads the repeated
   strings off adjacent common prefixes;
5. blocks cut what was reported.

A block collapses its own repeats before anything is sent, whatever the number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mix, text_bytes, total_bytes
from .suffix import equal_prefixes, suffix_order, words_at

#: Bytes of text in a block, and in a bucket of k-grams or stretches.
BLOCK = 4 << 20
#: Bytes of text that a task gets at most on average, where the shuffle has too few tasks for it.
TASK = 64 << 20
#: Bytes of a k-gram. Smaller ones are chosen less often, larger ones repeat less often by chance.
GRAM = 32
#: Different stretches of one k-gram (summed over blocks) from which its strings are dealt by their own content.
HOT = 2048

_PIECE = 1 << 19
_MARK = np.uint64((1 << 22) - 1)


class Block:
    """The documents of one block, ordered by doc_id and then by text."""

    def __init__(self, table: pa.Table, length: int):
        ids = table["doc_id"].to_numpy()
        data, offsets = buffers(table["text"])
        texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.texts, self.length, self.order = ids[order], [texts[i] for i in order], length, order
        same = np.concatenate([[False], self.ids[1:] == self.ids[:-1]]) if len(ids) else np.zeros(0, bool)
        run = np.arange(len(ids))
        self.copy = (run - np.maximum.accumulate(np.where(same, 0, run))).astype(np.int32)  # 0, 1, .. among rows of one doc_id

    def pieces(self) -> Iterator[tuple[int, int]]:
        lo = 0
        while lo < len(self.texts):
            hi, total = lo, 0
            while hi < len(self.texts) and (hi == lo or total + len(self.texts[hi]) <= _PIECE):
                total += len(self.texts[hi])
                hi += 1
            yield lo, hi
            lo = hi

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of string starts that choose one k-gram: document, first start, number of starts, k-gram hash."""
        found = []
        for lo, hi in self.pieces():
            sizes = np.array([len(x) for x in self.texts[lo:hi]], np.int64)
            ends = np.cumsum(sizes)
            block = np.frombuffer(b"".join(self.texts[lo:hi]), np.uint8)
            if len(block) < self.length:
                continue
            h = gram_hashes(block)
            for doc, at, n, gram in _chosen(block, h, ends, self.length):
                found.append((doc + lo, at - (ends[doc] - sizes[doc]), n, gram))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def gram_hashes(block: np.ndarray) -> np.ndarray:
    """Hashes of the k-grams at every position that has one."""
    n = len(block) - GRAM + 1
    padded = np.concatenate([block, np.zeros(8, np.uint8)])
    w = np.ndarray(len(block), "<u8", padded, strides=(1,))
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for step in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += w[step : step + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _chosen(block: np.ndarray, h: np.ndarray, ends: np.ndarray, length: int):
    """Runs of starts by chosen k-gram, in windows of positions that the mark can number."""
    span = length - GRAM + 1
    step = int(_MARK) - span
    for base in range(0, len(block) - length + 1, step):
        part = h[base : base + step + span - 1]
        v = (part & ~_MARK) | np.arange(len(part), dtype=np.uint64)
        width = 1
        least = v
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            rest = span - width
            least = np.minimum(least[:-rest], least[rest:])
        starts = np.arange(base, base + len(least))
        doc = np.searchsorted(ends, starts, side="right")
        whole = starts + length <= ends[doc]
        pick = (least & _MARK).astype(np.int64)
        new = np.ones(len(pick), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
        new &= whole
        at = np.flatnonzero(new)
        if not len(at):
            continue
        group = np.cumsum(new) - 1
        n = np.bincount(group[whole], minlength=len(at))
        yield doc[at], starts[at], n.astype(np.int64), part[pick[at]]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    if len(order):
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for s, e in zip(at, [*at[1:], len(order)], strict=True):
            yield int(bucket[order[s]]), order[s:e]


_NAMED = np.dtype([("gram", "<u8"), ("kinds", "<u4")])
_ASKED = np.dtype([("gram", "<u8"), ("hot", "<u4")])
_SENT = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("start", "<i4"), ("starts", "<i4"), ("home", "<i4"), ("bytes", "<i4")])
_CUT = np.dtype([("doc", "<i8"), ("copy", "<i4"), ("start", "<i4"), ("end", "<i4")])


def _name(buckets: int, length: int):
    """Step 1: (bucket, block, blob of k-grams with the number of different stretches)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        block = Block(table, length)
        doc, at, n, gram = block.stretches()
        grams, where, count = np.unique(gram, return_inverse=True, return_counts=True)
        kinds = np.ones(len(grams), np.uint32)
        seen: dict[int, set[int]] = {}
        for i in np.flatnonzero(count[where] > 1):
            seen.setdefault(int(where[i]), set()).add(hash(block.texts[doc[i]][at[i] : at[i] + n[i] + length - 1]))
        for g, x in seen.items():
            kinds[g] = max(2, len(x))  # repeated here: at least two, so that it is reported back
        out = np.zeros(len(grams), _NAMED)
        out["gram"], out["kinds"] = grams, kinds
        rows = [(b, out[i].tobytes()) for b, i in _by_bucket((grams % np.uint64(buckets)).astype(np.int64))]
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return run


def _ask(hot: int):
    """Step 2: (block, blob of the k-grams to cut there)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        parts = [np.frombuffer(x, _NAMED) for x in table["blob"].to_pylist()]
        home = np.repeat(table["block"].to_numpy(), [len(x) for x in parts])
        named = np.concatenate(parts)
        grams, where = np.unique(named["gram"], return_inverse=True)
        kinds = np.bincount(where, weights=named["kinds"])
        again = kinds[where] > 1
        out = np.zeros(int(again.sum()), _ASKED)
        out["gram"], out["hot"] = named["gram"][again], kinds[where][again] > hot
        rows = [(b, out[i].tobytes()) for b, i in _by_bucket(home[again])]
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return run


def _send(buckets: int, length: int):
    """Step 3: (bucket, stretches, their bytes); those that repeat one of the block itself go without bytes."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, asked: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        want = np.concatenate([np.zeros(0, _ASKED), *(np.frombuffer(x, _ASKED) for x in asked["blob"].to_pylist())])
        want = want[np.argsort(want["gram"])]
        empty = pa.table({"bucket": pa.array([], pa.int64()), "blob": pa.array([], pa.binary()), "bytes": pa.array([], pa.binary())})
        if not len(want) or not docs.num_rows:
            return empty
        block = Block(docs, length)
        doc, at, n, gram = block.stretches()
        where = np.minimum(np.searchsorted(want["gram"], gram), len(want) - 1)
        mine = np.flatnonzero(want["gram"][where] == gram)
        hot = want["hot"][where[mine]] > 0
        first: set[bytes] = set()
        rows: list[tuple] = []
        content: list[bytes] = []
        home = key[0].as_py()
        for i, split in zip(mine.tolist(), hot.tolist(), strict=True):  # in the order of documents and starts
            d, a, m = int(doc[i]), int(at[i]), int(n[i])
            whole = block.texts[d][a : a + m + length - 1]
            if whole in first:
                rows.append((0, block.ids[d], block.copy[d], a, m, home, 0))
                content.append(b"")
                continue
            first.add(whole)
            if not split:
                rows.append((gram[i], block.ids[d], block.copy[d], a, m, home, len(whole)))
                content.append(whole)
                continue
            for j in range(m):
                one = whole[j : j + length]
                again = m > 1 and one in first
                if m > 1:
                    first.add(one)
                own = int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "little")
                rows.append((0 if again else own, block.ids[d], block.copy[d], a + j, 1, home, 0 if again else length))
                content.append(b"" if again else one)
        out = np.array(rows, _SENT)
        to = np.where(out["bytes"] > 0, mix(out["gram"], 3) % np.uint64(buckets), np.uint64(home % buckets)).astype(np.int64)
        made = [(b, out[i].tobytes(), b"".join([content[j] for j in i])) for b, i in _by_bucket(to)]
        return pa.table({"bucket": pa.array([x[0] for x in made], pa.int64()), "blob": pa.array([x[1] for x in made], pa.binary()), "bytes": pa.array([x[2] for x in made], pa.binary())})

    return run


def repeated(rows: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """The stretches to cut, of stretches given in the order of documents and starts (texts empty: to be cut whole)."""
    cut = [(r["doc"], r["copy"], r["start"], r["start"] + r["starts"] + length - 1, r["home"]) for r in rows[rows["bytes"] == 0]]
    kinds: dict[int, list[int]] = {}
    first: set[bytes] = set()
    for i in np.flatnonzero(rows["bytes"] > 0).tolist():
        r = rows[i]
        if texts[i] in first:
            cut.append((r["doc"], r["copy"], r["start"], r["start"] + r["starts"] + length - 1, r["home"]))
        else:
            first.add(texts[i])
            kinds.setdefault(int(r["gram"]), []).append(i)
    left = sorted(i for x in kinds.values() if len(x) > 1 for i in x)
    if left:
        sizes = np.array([len(texts[i]) for i in left], np.int64)
        block = np.frombuffer(b"".join([texts[i] for i in left]), np.uint8)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(left)), sizes)
        words = words_at(block)
        order = suffix_order(block, words, length)
        order = order[order + length <= (begin + sizes)[owner[order]]]
        same = equal_prefixes(order, words, length)
        group = np.cumsum(~same)
        lead = np.full(int(group[-1]) + 1 if len(group) else 1, len(block), np.int64)
        np.minimum.at(lead, group, order)
        again = np.sort(order[order != lead[group]])
        if len(again):  # neighbouring starts of one stretch as one cut
            new = np.ones(len(again), bool)
            new[1:] = (again[1:] != again[:-1] + 1) | (owner[again[1:]] != owner[again[:-1]])
            s = np.flatnonzero(new)
            e = np.append(s[1:], len(again)) - 1
            for a, b in zip(again[s], again[e], strict=True):
                r = rows[left[owner[a]]]
                shift = r["start"] - begin[owner[a]]
                cut.append((r["doc"], r["copy"], a + shift, b + shift + length, r["home"]))
    return cut


def _judge(length: int):
    """Step 4: (block, blob of cuts)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        parts = [np.frombuffer(x, _SENT) for x in table["blob"].to_pylist()]
        texts: list[bytes] = []
        for part, data in zip(parts, table["bytes"].to_pylist(), strict=True):
            ends = np.cumsum(part["bytes"]).tolist()
            texts += [data[e - n : e] for e, n in zip(ends, part["bytes"].tolist(), strict=True)]
        rows = np.concatenate(parts)
        order = np.lexsort((rows["start"], rows["copy"], rows["doc"]))
        cut = repeated(rows[order], [texts[i] for i in order.tolist()], length)
        out = np.array([x[:4] for x in cut], _CUT) if cut else np.zeros(0, _CUT)
        made = [(b, out[i].tobytes()) for b, i in _by_bucket(np.array([x[4] for x in cut], np.int64))]
        return pa.table({"block": pa.array([x[0] for x in made], pa.int64()), "blob": pa.array([x[1] for x in made], pa.binary())})

    return run


def spans_of(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of intervals; touching intervals make one."""
    cuts = cuts[np.argsort(cuts["start"], kind="stable")]
    reach = np.maximum.accumulate(cuts["end"])
    new = np.ones(len(cuts), bool)
    new[1:] = cuts["start"][1:] > reach[:-1]
    at = np.flatnonzero(new)
    return cuts["start"][at].astype(np.int64), reach[np.append(at[1:], len(cuts)) - 1].astype(np.int64)


def whole_characters(text: bytes, starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Runs narrowed so that none begins or ends inside a UTF-8 character; runs without a whole character go."""
    out = []
    for s, e in zip(starts, ends, strict=True):
        while s < e and 128 <= text[s] < 192:
            s += 1
        while e > s and e < len(text) and 128 <= text[e] < 192:
            e -= 1
        if s < e:
            out.append((s, e))
    return [s for s, _ in out], [e for _, e in out]


def _apply(length: int, characters: bool, carried: list[str]):
    """Step 5: a row for each document of the block, with its maximal removed runs."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, cuts: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        block = Block(docs, length)
        cut = np.concatenate([np.zeros(0, _CUT), *(np.frombuffer(x, _CUT) for x in cuts["blob"].to_pylist())])
        cut = cut[np.lexsort((cut["start"], cut["copy"], cut["doc"]))]
        starts, ends, kept = [], [], []
        for d, c, text in zip(block.ids.tolist(), block.copy.tolist(), block.texts, strict=True):
            lo, hi = np.searchsorted(cut["doc"], [d, d + 1])
            own = cut[lo:hi][cut["copy"][lo:hi] == c]
            s, e = (x.tolist() for x in spans_of(own)) if len(own) else ([], [])
            s, e = whole_characters(text, s, e) if characters else (s, e)
            starts.append(s)
            ends.append(e)
            kept.append(b"".join(text[a:b] for a, b in zip([0, *ends[-1]], [*starts[-1], len(text)], strict=True)))
        others = docs.select(carried).take(pa.array(block.order, pa.int64()))
        return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "copy": pa.array(block.copy, pa.int32()), "n_bytes": pa.array([len(x) for x in block.texts], pa.int64()), "starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64())), "kept_text": pa.array(kept, pa.binary())} | dict(zip(carried, others.columns, strict=True)))

    return run


def remove_repeats(docs: DataFrame, length: int = 100, block_bytes: int = BLOCK, hot: int = HOT, characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, copy, n_bytes, starts, ends, kept_text)`` of each row of ``docs`` (doc_id, text; others are ignored).

    ``starts`` and ``ends`` are the maximal removed runs of bytes: every byte covered by a string of ``length`` bytes
    that also starts earlier, in a smaller doc_id or before in the same text. ``kept_text`` holds the other bytes. Null
    and empty texts have no bytes and lose none. Rows of one doc_id count in the order of their texts (``copy`` 0, 1, ..)
    so that of repeated rows the first stays. With ``characters`` runs are narrowed to whole UTF-8 characters. Columns in ``carry`` come along as a struct ``carried``. Rows without a doc_id are left out. ``length`` is at least twice the
    k-gram. An empty table gives an empty result.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    others = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), *others)
    carried = [f"_c{i}" for i in range(len(carry))]
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    total = total_bytes(docs)
    blocks = max(1, -(-total // block_bytes))
    tasks = total // TASK
    # More tasks than a shuffle has by default where there is more than TASK for each; the grouping below keeps this dealing.
    deal = lambda df, by: df.repartition(tasks, by) if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
    dealt = deal(docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))), "block")
    buckets = max(1, -(-blocks // 2))
    named = deal(dealt.groupBy("block").applyInArrow(_name(buckets, length), "bucket long, block long, blob binary"), "bucket")
    asked = named.groupBy("bucket").applyInArrow(_ask(hot), "block long, blob binary")
    sent = deal(dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_send(buckets, length), "bucket long, blob binary, bytes binary"), "bucket")
    cuts = sent.groupBy("bucket").applyInArrow(_judge(length), "block long, blob binary")
    out = dealt.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(_apply(length, characters, carried), f"doc_id long, copy int, n_bytes long, starts array<long>, ends array<long>, kept_text binary{kinds}")
    return out if not carry else out.select(*out.columns[:6], F.struct(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry))).alias("carried"))
