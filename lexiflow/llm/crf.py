"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score for bad is linear in features of its bytes and of the lines beside it; one
weight for each pair of neighbouring labels makes labels persist. Only documents are labelled: lines of good documents
are good; lines of bad documents start as bad and are then relabelled by the field itself, the worst line staying bad.
Forward and backward passes give each line's probability of being good; their mean, weighted by length, is a
document's share of good text, which a logistic curve fitted on the same documents turns into the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import text_bytes, text_source, texts

#: Most labelled rows to train on: those with the least hashes of their doc_id.
TRAIN_ROWS = 4000
#: Most lines of a text to learn from: a run of its lines, from a place that the text's hash gives.
TRAIN_LINES = 512
#: Base features of a line: their square roots join them, then the neighbours' mean of both.
BASE = 12

_UPPER = bytes(range(65, 91))
_LETTER = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT = b"0123456789"
_SYMBOL = b"#$%&*+/<=>@\\^_`{}~[]"
_STOP = b",.;:'\"()-"


def line_features(line: bytes) -> tuple[float, ...]:
    """``BASE`` numbers from 0 to 1 of one line."""
    n = len(line) or 1
    words = line.split()
    m = len(words) or 1
    share = [(len(line) - len(line.translate(None, kind))) / n for kind in (_UPPER, _LETTER, _DIGIT, _SYMBOL, b"!?", b"|", _STOP)]
    again = sum(map(eq, words, words[1:])) / m
    return (*share, again, 1 - len(set(words)) / m if words else 0.0, min(1.0, len(line) / m / 40), min(1.0, np.log1p(len(line)) / 12), 1.0 if not words else 0.0)


def text_lines(text: bytes) -> list[bytes]:
    """Lines of a text; an empty text is one empty line."""
    return text.split(b"\n")


class Batch:
    """Line features of several documents, laid out by position so that one step serves all documents."""

    def __init__(self, base: np.ndarray, lengths: np.ndarray, counts: np.ndarray):
        """base: rows of features, document after document; lengths: bytes of each line; counts: lines of each document."""
        self.counts, self.weights = counts, lengths + 1.0
        both = np.concatenate([base, np.sqrt(base)], axis=1)
        ends = np.cumsum(counts)
        first, last = np.zeros(len(base), bool), np.zeros(len(base), bool)
        first[ends - counts], last[ends - 1] = True, True
        before, after = np.roll(both, 1, axis=0), np.roll(both, -1, axis=0)
        before[first], after[last] = 0, 0
        beside = (before + after) / np.maximum(1, 2.0 - first - last)[:, None]
        self.x = np.concatenate([both, beside, np.ones((len(base), 1))], axis=1)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(-counts, kind="stable")
        self.starts = (ends - counts)[order]
        self.active = np.searchsorted(-counts[order], -np.arange(counts.max() if len(counts) else 0), side="left")
        self.first, self.last = first, last

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of bad of each line, and expected counts of neighbouring labels (good, bad) x (good, bad)."""
        emit = np.zeros((len(self.x), 2))
        emit[:, 1] = np.clip(self.x @ w, -40, 40)
        emit -= emit.max(axis=1, keepdims=True)
        e, t = np.exp(emit), np.exp(pair)
        forward, backward = np.empty_like(e), np.ones_like(e)
        for k, n in enumerate(self.active):
            at = self.starts[:n] + k
            a = e[at] if k == 0 else (forward[at - 1] @ t) * e[at]
            forward[at] = a / a.sum(axis=1, keepdims=True)
        for k in range(len(self.active) - 1, 0, -1):
            at = self.starts[: self.active[k]] + k
            b = (backward[at] * e[at]) @ t.T
            backward[at - 1] = b / b.sum(axis=1, keepdims=True)
        p = forward * backward
        p /= p.sum(axis=1, keepdims=True)
        right = np.flatnonzero(~self.first)
        joint = forward[right - 1][:, :, None] * t[None] * (e[right] * backward[right])[:, None, :]
        joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
        return p[:, 1], joint.sum(axis=0)

    def good_share(self, model: dict) -> np.ndarray:
        bad, _ = self.marginals(model["w"], model["pair"])
        return np.bincount(self.doc, (1 - bad) * self.weights, len(self.counts)) / np.bincount(self.doc, self.weights, len(self.counts))


def _fit(batch: Batch, y: np.ndarray, chain: bool, steps: int, w: np.ndarray, pair: np.ndarray, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean log likelihood of line labels ``y`` (1 is bad)."""
    n = len(y)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum())) * n if not chain else np.ones(n)
    right = np.flatnonzero(~batch.first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[right - 1], y[right]), 1)
    m = [np.zeros_like(w), np.zeros_like(pair)]
    v = [np.zeros_like(w), np.zeros_like(pair)]
    for i in range(1, steps + 1):
        bad, joint = batch.marginals(w, pair)
        g = [batch.x.T @ ((y - bad) * weight) / n - l2 * w, (seen - joint) / n - l2 * pair if chain else np.zeros((2, 2))]
        for k, value in enumerate((w, pair)):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            value += 0.15 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
    return w, pair


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton steps for one feature and a constant; classes weigh alike."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    c, weight = np.zeros(2), np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-4 * np.eye(2)
        c = c + np.clip(np.linalg.solve(h, a.T @ (weight * (y - p)) - 1e-4 * c), -5, 5)
    return c


def _view(share: np.ndarray) -> np.ndarray:
    """Shares near 1 spread out: what tells a few bad lines from none."""
    return -np.log10(1 - np.clip(share, 0, 1) + 1e-3)


def train(base: np.ndarray, lengths: np.ndarray, counts: np.ndarray, quality: np.ndarray) -> dict:
    """Weights from labelled documents; without documents of both kinds every score is the share of good ones (or 0.5)."""
    d = 4 * BASE + 1
    model = {"w": np.zeros(d), "pair": np.zeros((2, 2)), "curve": np.zeros(2), "flat": float(quality.mean()) if len(quality) else 0.5}
    if not len(quality) or quality.min() == quality.max():
        return model
    model["flat"] = None
    batch = Batch(base, lengths, counts)
    y = (1 - quality)[batch.doc].astype(np.int64)
    w, pair = _fit(batch, y, False, 120, model["w"], model["pair"])
    for steps in (80, 80):
        score = batch.x @ w
        worst = np.full(len(counts), -np.inf)
        np.maximum.at(worst, batch.doc, score)
        y = ((1 - quality)[batch.doc] * ((score > 0) | (score == worst[batch.doc]))).astype(np.int64)
        w, pair = _fit(batch, y, False, steps, w, pair)
    model["w"], model["pair"] = _fit(batch, y, True, 150, w, pair)
    model["curve"] = _logistic(_view(batch.good_share(model)), quality)
    return model


def scores(batch: Batch, model: dict) -> np.ndarray:
    if model["flat"] is not None:
        return np.full(len(batch.counts), model["flat"])
    a, b = model["curve"]
    return 1 / (1 + np.exp(-np.clip(a * _view(batch.good_share(model)) + b, -30, 30)))


def _run(lines: list[bytes], most: int, place: int) -> list[bytes]:
    """At most ``most`` neighbouring lines."""
    start = place % (len(lines) - most + 1) if len(lines) > most else 0
    return lines[start : start + most]


def _measured(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = [x for t in lines for x in t]
    return np.array([line_features(x) for x in flat]).reshape(-1, BASE), np.array([len(x) for x in flat]), np.array([len(t) for t in lines])


def _feature_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                whole = (t.as_buffer().to_pybytes() for t in part["text"])
                made = [_measured([_run(text_lines(t), most, zlib.crc32(t))]) for t in whole]
                yield pa.RecordBatch.from_arrays([part["quality"], pa.array([b.astype("<f4").tobytes() for b, _, _ in made], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n, _ in made], pa.binary())], ["quality", "features", "lengths"])

    return run


def _score_batches(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = scores(Batch(*_measured([text_lines(t) for t in texts(part)])), model)
                yield pa.RecordBatch.from_arrays([part["carried"], pa.array(found)], ["carried", "score"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int | None = None, train_lines: int = TRAIN_LINES) -> dict:
    """A model from at most ``train_rows`` rows of ``labels`` (doc_id, quality) with a text in ``docs``.

    The caller leaves held-out rows out of ``labels``. Null labels are left out; of several for one doc_id the smallest counts,
    and of several texts the least. Of a text with more than ``train_lines`` lines a run of so many neighbouring ones is learned
    from, so what the driver gets is at most ``train_rows * train_lines`` lines of 52 bytes (106 MB), however long texts are.
    With ``train_bytes``, texts of more bytes are left out besides.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(sample), "doc_id")  # the broadcast is bounded by train_rows
    if train_bytes is not None:
        rows = rows.where(F.octet_length("text") <= train_bytes)
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    made = sorted((r["quality"], bytes(r["features"]), bytes(r["lengths"])) for r in rows.select("quality", "text").mapInArrow(_feature_batches(train_lines), "quality int, features binary, lengths binary").collect())
    if not made:
        return train(np.zeros((0, BASE)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    lengths = [np.frombuffer(n, "<i4") for _, _, n in made]
    base = np.concatenate([np.frombuffer(f, "<f4") for _, f, _ in made]).reshape(-1, BASE).astype(float)
    return train(base, np.concatenate(lengths).astype(float), np.array([len(n) for n in lengths]), np.array([q for q, _, _ in made], float))


def quality_scores(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """``carry`` columns and ``out`` (0 to 1, higher: likelier good) of each row of ``docs``; null text as empty.

    Rows are scored one by one from their text alone: repeated rows get equal scores, an empty table no rows. ``out``
    must not be one of the carried columns.
    """
    rows = docs.select(*text_source(carry))
    scored = rows.mapInArrow(_score_batches(model), StructType([rows.schema["carried"], StructField("score", DoubleType())]))
    return scored.select(*(F.col(f"carried.`{c}`") for c in carry), F.col("score").alias(out))
