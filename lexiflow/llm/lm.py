"""Masked pseudo-likelihood of documents by a small bidirectional window network.

Every token is predicted from the tokens on both sides of it: their embeddings pass one hidden layer to the classes of
words and, within the token's own class, to the words. The sum of the log probabilities scores a document. All words of
the corpus are counted, and every task trains the network on all tokens of its partition from one common start; the
networks are averaged, weighted by tokens, in a tree of small groups. The network knows the most frequent words and
hashed buckets of all others; a word of a bucket has the bucket's probability times its own share of the bucket, from
the counts of the corpus, which stay a distributed table and meet the documents' words in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_bytes
from .decontaminate import words_of

#: Classes of words and words in each: the vocabulary has their product; its last BUCKETS entries are hashes of all other words.
CLASSES, SIZE, BUCKETS = 32, 32, 64
#: Tokens on each side, numbers of an embedding and of the hidden layer, tokens of a training step, learning rate.
SIDE, WIDTH, HIDDEN, STEP, RATE = 2, 8, 24, 2048, 0.02
#: Tokens that are scored at once.
SCORED = 16384
#: Other words, and their places, that a task holds before it gives them out; members of a group of the averaging tree.
WORDS, PLACES, GROUP = 200_000, 1_000_000, 64
#: Added to every count of a word within its bucket, and one share for words that were never counted.
SMOOTH = 0.5
#: Parts of 1 in which log shares are added up, so that sums don't depend on their order.
FINE = 1 << 30


class Vocabulary(dict):
    """Numbers of words: first those of the list, which are their ids, then others as they come; these share the hashed ids."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: i for i, w in enumerate(words)})
        self.listed, self.ids, self.fresh = len(words), np.arange(len(words), dtype=np.int16), []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.fresh.append(CLASSES * SIZE - BUCKETS + zlib.crc32(word) % BUCKETS)
        return i

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        if self.fresh:
            self.ids, self.fresh = np.concatenate([self.ids, np.array(self.fresh, np.int16)]), []
        return self.ids[numbers]

    def others(self) -> list[bytes]:
        """The words beyond the list, in the order of their numbers; they are forgotten."""
        found = list(islice(self, self.listed, None))
        for w in found:
            del self[w]
        self.ids, self.fresh = self.ids[: self.listed], []
        return found


PAD = CLASSES * SIZE


def _softmax(x: np.ndarray, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities at ``(row, column)`` and all probabilities, of the columns of ``x``, which is overwritten."""
    x -= x.max(axis=0)
    at = x[row, column]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x /= total
    return at - np.log(total), x


class Network:
    """Window network with a two-level softmax, float32."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *s: r.normal(0, 0.1, s).astype(np.float32)
        first = [normal(PAD + 1, WIDTH), normal(2 * SIDE * WIDTH, HIDDEN) * 3, np.zeros(HIDDEN, np.float32), normal(HIDDEN, CLASSES), np.zeros(CLASSES, np.float32), normal(CLASSES, HIDDEN, SIZE), np.zeros((CLASSES, SIZE), np.float32)]
        self.all = np.concatenate([x.ravel() for x in first])
        # Views of one vector, so that a step of Adam is a few operations.
        ends = np.cumsum([x.size for x in first])[:-1]
        self.p = [part.reshape(x.shape) for part, x in zip(np.split(self.all, ends), first, strict=True)]
        self.m, self.v, self.t = np.zeros_like(self.all), np.zeros_like(self.all), 0

    def dump(self) -> bytes:
        return self.all.astype("<f4").tobytes()

    def load(self, blob: bytes) -> Network:
        self.all[:] = np.frombuffer(blob, "<f4")
        return self

    def run(self, context: np.ndarray, y: np.ndarray, learn: bool = False) -> np.ndarray:
        """Log probabilities of ``y`` given ``context`` (a column for each neighbour); one step of Adam if ``learn``."""
        e, w, b, c, cb, o, ob = self.p
        n = len(y)
        # In the order of classes, so that each class is one slice; a column for each token, so that sums run along rows.
        order = np.argsort(y // SIZE, kind="stable")
        y, context = y[order], context[order]
        kind, word, every = y // SIZE, y % SIZE, np.arange(n)
        x = e[context].reshape(n, -1)
        h = np.tanh(x @ w + b)
        cut = np.searchsorted(kind, np.arange(CLASSES + 1))
        met = [(k, slice(cut[k], cut[k + 1])) for k in range(CLASSES) if cut[k] < cut[k + 1]]
        top, low = c.T @ h.T + cb[:, None], np.repeat(ob.T, np.diff(cut), axis=1)
        for k, of in met:
            low[:, of] += o[k].T @ h[of].T
        top_score, p = _softmax(top, kind, every)
        low_score, q = _softmax(low, word, every)
        score = top_score + low_score
        if learn:
            g = [None] * 7
            np.negative(p, out=p)
            p[kind, every] += 1
            g[3], g[4], dh = h.T @ p.T, p.sum(axis=1), p.T @ c.T
            np.negative(q, out=q)
            q[word, every] += 1
            g[5], g[6] = np.zeros_like(o), np.zeros_like(ob)
            g[6][[k for k, _ in met]] = np.add.reduceat(q, [of.start for _, of in met], axis=1).T
            for k, of in met:
                g[5][k] = h[of].T @ q[:, of].T
                dh[of] += q[:, of].T @ o[k].T
        if learn:
            dh *= 1 - h * h
            g[1], g[2] = x.T @ dh, dh.sum(axis=0)
            dx = (dh @ w.T).reshape(-1, WIDTH)
            flat = context.ravel()
            g[0] = np.stack([np.bincount(flat, dx[:, j], len(e)) for j in range(WIDTH)], axis=1).astype(np.float32)
            self.t += 1
            up = np.concatenate([x.ravel() for x in g]) / n
            self.m += 0.1 * (up - self.m)
            self.v += 0.01 * (up * up - self.v)
            self.all += RATE / (1 + self.t / 400) * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)
        out = np.empty_like(score)
        out[order] = score
        return out


def contexts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of every token (padding beyond a document), the tokens, and the number of each one's document."""
    gap = np.full(SIDE, PAD, np.int32)
    flat = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    at = np.flatnonzero(flat != PAD)
    steps = [s for s in range(-SIDE, SIDE + 1) if s]
    return np.stack([flat[at + s] for s in steps], axis=1) if len(at) else np.zeros((0, 2 * SIDE), np.int32), flat[at], doc


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            yield part, [t.as_buffer().to_pybytes() for t in part["text"]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return made

    for _, texts in _texts(batches):
        for t in texts:
            held.update(words_of(t))
        if len(held) > WORDS:
            yield out()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of all words of all texts."""
    return docs.select(text_bytes().alias("text")).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> list[bytes]:
    """The most frequent words (ties by the word), as many as the network has ids for."""
    top = counts.orderBy(F.col("n").desc(), "word").limit(CLASSES * SIZE - BUCKETS)
    return [bytes(r["word"]) for r in top.collect()]


def bucket_shares(counts: DataFrame, words: list[bytes]) -> tuple[DataFrame, DataFrame]:
    """``(word, share)`` of every counted word outside the list, and ``(bucket, other)`` for words that weren't counted.

    Both are natural logs in parts of ``1 / FINE``: of the word's part of its bucket's tokens, smoothed. The shares of a
    bucket, that of all uncounted words included, sum to 1.
    """
    log = lambda share: F.round(F.log(share) * FINE).cast("long")
    listed = counts.sparkSession.createDataFrame([(w,) for w in words], "word binary")  # bounded by CLASSES * SIZE words
    rare = counts.join(F.broadcast(listed), "word", "left_anti").withColumn("bucket", F.crc32("word") % BUCKETS)
    sums = rare.groupBy("bucket").agg((F.sum("n") + SMOOTH * (F.count("*") + 1)).alias("total"))
    every = counts.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(F.broadcast(sums), "bucket", "left").withColumn("total", F.coalesce("total", F.lit(SMOOTH)))
    shares = rare.join(F.broadcast(every), "bucket").select("word", log((F.col("n") + SMOOTH) / F.col("total")).alias("share"))
    return shares, every.select("bucket", log(SMOOTH / F.col("total")).alias("other"))


#: A row of a document has its ids, a row of a word outside the list the documents (of one stretch of a task) that it stands in.
ENCODED = "row long, doc_id long, ids binary, word binary, places array<struct<row: long, n: long>>"


def _encode(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = Vocabulary(words.value), TaskContext.get().partitionId() << 33
        held: list[np.ndarray] = []  # number of a word, row, times

        def places() -> pa.RecordBatch:
            number, at, n = np.concatenate(held, axis=1)
            held.clear()
            order = np.argsort(number, kind="stable")
            others = known.others()
            ends = np.cumsum([0, *np.bincount(number - known.listed, minlength=len(others))]).astype(np.int32)
            members = pa.StructArray.from_arrays([pa.array(at[order]), pa.array(n[order])], ["row", "n"])
            none = [pa.nulls(len(others), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(others, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), members)], names)

        names = ["row", "doc_id", "ids", "word", "places"]
        for part, texts in _texts(batches):
            numbers = [known.numbers(words_of(t)) for t in texts]
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            ids = pa.array([known.ids_of(x).astype("<i2").tobytes() for x in numbers], pa.binary())
            members = pa.nulls(len(texts), pa.list_(pa.struct([("row", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(rows), part["doc_id"], ids, pa.nulls(len(texts), pa.binary()), members], names)
            flat = np.concatenate(numbers).astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
            pair, n = np.unique(flat[flat >= known.listed * len(texts)], return_counts=True)
            if len(pair):
                held.append(np.stack([pair // len(texts), rows[pair % len(texts)], n]))
            if len(known) > known.listed + WORDS or sum(x.shape[1] for x in held) > PLACES:
                yield places()
        if held:
            yield places()

    return run


def encoded(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """Texts as ids of the network, and the places of all words outside the list, as a written table of ``ENCODED``."""
    held = docs.sparkSession.sparkContext.broadcast(words)  # bounded by CLASSES * SIZE words
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return materialise(rows.mapInArrow(_encode(held), ENCODED))


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            yield part, [np.frombuffer(x.as_buffer(), "<i2").astype(np.int32) for x in part["ids"]]


def _train(start: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Network().load(start), 0
        for _, ids in _ids(batches):
            context, y, _ = contexts(ids)
            seen += len(y)
            for i in range(0, len(y), STEP):
                net.run(context[i : i + STEP], y[i : i + STEP], learn=True)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([net.dump()], pa.binary())], ["part", "n", "net"])

    return run


def _mean(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["part"].to_pylist(), table["n"].to_pylist(), table["net"].to_pylist(), strict=True))
    n = sum(r[1] for r in rows)
    total = sum(np.frombuffer(r[2], "<f4").astype(float) * r[1] for r in rows) / n
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "net": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def train(texts: DataFrame, rounds: int = 1) -> bytes:
    """The network after ``rounds`` over all ``ids`` of ``texts``; each starts from the average of the one before."""
    blob = Network().dump()
    for _ in range(rounds):
        rows = texts.select("ids")
        width = max(1, rows.rdd.getNumPartitions())
        nets = rows.mapInArrow(_train(blob), "part long, n long, net binary")
        while width > 1:
            nets = nets.withColumn("part", F.floor(F.col("part") / GROUP).cast("long")).groupBy("part").applyInArrow(_mean, "part long, n long, net binary")
            width = -(-width // GROUP)
        found = nets.collect()  # one network
        blob = bytes(found[0]["net"]) if found else blob
    return blob


def _score(blob: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network().load(blob)
        for part, ids in _ids(batches):
            context, y, doc = contexts(ids)
            logs = np.concatenate([np.zeros(0), *(net.run(context[i : i + SCORED], y[i : i + SCORED]).astype(float) for i in range(0, len(y), SCORED))])
            yield pa.RecordBatch.from_arrays([part["row"], part["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array(np.bincount(doc, logs, len(ids)).astype(float))], ["row", "doc_id", "n_tokens", "network"])

    return run


def pseudo_likelihood(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """``(doc_id, n_tokens, pseudo_loglik, mean_loglik)`` of each row of ``docs`` (doc_id, text; others are ignored).

    ``pseudo_loglik`` sums the natural log probability of each token given ``SIDE`` tokens on both sides: by the network
    for words of the list, by the network and the word's share of its bucket for all others; ``mean_loglik`` is per
    token, null without tokens. Tokens are lower-cased (A-Z) words. Null and empty texts have no tokens and sum 0.
    Repeated rows score alike. An empty table gives no rows. The network is the average of those of the tasks, weighted by
    their tokens, so other partitions of the same rows give a slightly other network; the same partitions give the same.
    """
    counts = materialise(word_counts(docs))
    words = vocabulary(counts)
    rows = encoded(docs, words)
    texts = rows.where("word is null").select("row", "doc_id", "ids")
    scored = materialise(texts.mapInArrow(_score(train(texts, rounds)), "row long, doc_id long, n_tokens long, network double"))
    shares, others = bucket_shares(counts, words)
    met = rows.where("word is not null").select("word", "places").join(shares, "word", "left")
    met = met.withColumn("bucket", F.crc32("word") % BUCKETS).join(F.broadcast(others), "bucket")
    added = met.select(F.coalesce("share", "other").alias("share"), F.explode("places").alias("x")).groupBy("x.row").agg(F.sum(F.col("x.n") * F.col("share")).alias("added"))
    done = scored.join(added, "row", "left").withColumn("pseudo_loglik", F.col("network") + F.coalesce(F.col("added") / FINE, F.lit(0.0))).select("doc_id", "n_tokens", "pseudo_loglik")
    return done.withColumn("mean_loglik", F.when(F.col("n_tokens") > 0, F.col("pseudo_loglik") / F.col("n_tokens")))
