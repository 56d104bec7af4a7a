"""Centroid clustering by dual-tree Lloyd rounds, exact in integers.

Vectors become integers and are laid out once, in blocks, as cover trees: nested nets by farthest-first traversal, every
point below the nearest net point of the level above, siblings apart, radii taken from the points themselves. Each round
makes the same kind of tree of the centroids, and every task walks both trees of its blocks together. A pair of a node of
vectors and a node of centroids is dropped when its least distance exceeds the largest distance that some other centroid
can have; a node of vectors with one centroid left is assigned as a whole; pairs of leaves are compared exactly, ties to
the smaller number. A task gives on one row of sums a centroid, so a round shuffles nothing that grows with the vectors.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Vectors of a block, and the mean number of points of a leaf.
BLOCK, LEAF = 1024, 8
#: Largest integer of a component: squared distances of 64 components and a block's sums then fit 64 bits.
LARGEST = 1 << 27
#: Pairs of points and centroids that are compared at once.
PAIRS = 1 << 14

OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Tree:
    """A cover tree. ``order`` lays the points out so that each node is a range; ``levels`` hold (first point, centre, radius) of their nodes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        x = points.astype(np.float64)
        n = len(x)
        net, owner, owners, parts = [0], np.zeros(n, np.int64), [], []
        near = _squares(x, x[0])
        limit = float(near.max()) / 4
        while True:
            far = int(near.argmax())
            done = near[far] == 0 or (len(net) - 1) * leaf >= n
            while not done and near[far] <= limit:
                owners.append(owner.copy())
                limit /= 4
            if done:
                break
            d = _squares(x, x[far])
            closer = d < near
            near[closer], owner[closer] = d[closer], len(net)
            parts.append(len(owners))
            net.append(far)
        owners.append(owner)
        # Net point above each net point, level by level: as the owner stood when the level above was complete.
        level = np.array([0, *parts])
        centre = np.array(net)
        above = [owners[-1]]
        for k in range(len(owners) - 2, -1, -1):
            up = np.where(level <= k, np.arange(len(net)), owners[k][centre])
            above.append(up[above[-1]])
        above.append(np.zeros(n, np.int64))
        self.order = np.lexsort(above)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for of in reversed(above):
            of = of[self.order]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if not self.levels else np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | held[1:]])
            held = np.zeros(n, bool)
            held[first] = True
            if self.levels and len(first) == len(self.levels[-1][0]):
                self.levels.pop()
            middle = centre[of[first]]
            away = np.sqrt(_squares(x[self.order], np.repeat(x[middle], np.diff(np.r_[first, n]), axis=0)))
            self.levels.append((first, middle, np.maximum.reduceat(away, first)))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.levels = [(first, place[middle], radius) for first, middle, radius in self.levels]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def _below(nodes: np.ndarray, here: np.ndarray, there: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of ``nodes``: which of them each belongs to, and its number on the level below; levels are given by first points."""
    ends = np.r_[here[1:], n]
    lo, hi = np.searchsorted(there, here[nodes]), np.searchsorted(there, ends[nodes])
    of = np.repeat(np.arange(len(nodes)), hi - lo)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[of]


class Centroids:
    """Centroids in the order of their tree; equal ones are left out but for the smallest number."""

    def __init__(self, values: list[list[int]]):
        first: dict[tuple[int, ...], int] = {}
        for i, v in enumerate(values):
            first.setdefault(tuple(v), i)
        number, points = np.array(list(first.values())), np.array(list(first), np.int64)
        tree = Tree(points, 1)
        self.levels, self.points, self.number = tree.levels, points[tree.order], number[tree.order]


def assign(points: np.ndarray, levels: list, centroids: Centroids) -> tuple[np.ndarray, int]:
    """Number of the nearest centroid of each of ``points`` (integers, in a tree's order), and how many distances of points were computed."""
    n, k = len(points), len(centroids.points)
    label = np.full(n, -1, np.int64)
    node = np.zeros(1, np.int64)  # pairs: node of vectors, node of centroids, ordered by the first
    other = np.zeros(1, np.int64)
    for depth in range(max(len(levels), len(centroids.levels))):
        a, b = min(depth, len(levels) - 1), min(depth, len(centroids.levels) - 1)
        if depth:
            if b == depth:
                of, other = _below(other, centroids.levels[b - 1][0], centroids.levels[b][0], k)
                node = node[of]
            if a == depth:
                of, down = _below(node, levels[a - 1][0], levels[a][0], n)
                rank = np.lexsort((other[of], down))
                node, other = down[rank], other[of][rank]
        first, middle, radius = levels[a]
        c_first, c_middle, c_radius = centroids.levels[b]
        d = np.sqrt(_squares(points[middle[node]].astype(np.float64), centroids.points[c_middle[other]].astype(np.float64)))
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        if not len(starts):
            break
        count = np.diff(np.r_[starts, len(node)])
        # A node's centre is itself a centroid, so no point is farther from its nearest one than this.
        most = np.repeat(np.minimum.reduceat(d + radius[node], starts), count)
        keep = d - radius[node] - c_radius[other] <= most * (1 + 1e-9) + 1e-6
        if len(c_first) == k:  # single centroids: beyond the plane between it and the nearest one of the node's centre
            best = np.repeat(np.lexsort((d, node))[starts], count)
            apart = np.sqrt(_squares(centroids.points[c_middle[other]].astype(np.float64), centroids.points[c_middle[other[best]]].astype(np.float64)))
            keep &= d * d - d[best] * d[best] <= 2 * radius[node] * apart + (d * d + 1) * 1e-9
        node, other = node[keep], other[keep]
        alone = np.r_[True, node[1:] != node[:-1]] & np.r_[node[1:] != node[:-1], True]
        alone &= np.diff(np.r_[c_first, k])[other] == 1
        ends = np.r_[first[1:], n]
        for v, c in zip(node[alone].tolist(), c_first[other[alone]].tolist(), strict=True):
            label[first[v] : ends[v]] = centroids.number[c]
        node, other = node[~alone], other[~alone]
    computed = 0
    if len(node):
        first = levels[-1][0]
        of, row = _below(node, first, np.arange(n), n)
        best = np.full((n, 2), np.iinfo(np.int64).max)
        for at in range(0, len(of), PAIRS):
            rows, near = row[at : at + PAIRS], other[of[at : at + PAIRS]]
            found = np.stack([_squares(points[rows], centroids.points[near]), centroids.number[near]], axis=1)
            rank = np.lexsort((found[:, 1], found[:, 0], rows))
            rows, found = rows[rank], found[rank]
            one = np.r_[True, rows[1:] != rows[:-1]]
            rows, found = rows[one], found[one]
            less = (found[:, 0] < best[rows, 0]) | ((found[:, 0] == best[rows, 0]) & (found[:, 1] < best[rows, 1]))
            best[rows[less]] = found[less]
        met = best[:, 1] != np.iinfo(np.int64).max
        label[met] = best[met, 1]
        computed = len(of)
    return label, computed


def kept_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """``(vec_id, p)``: vectors of exactly ``size`` components, none null or non-finite, each as floor(scale * x)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where((F.size("embedding") == size) & fine)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("p"))


def _whole(values: np.ndarray) -> np.ndarray:
    if len(values) and max(int(values.max()), -int(values.min())) > LARGEST:
        raise ValueError(f"a component times the scale exceeds {LARGEST}")
    return values


def _build(size: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held, n = [], [], 0

        def flush() -> pa.RecordBatch:
            points = np.concatenate(held)
            tree = Tree(points)
            ids = pa.concat_arrays(held_ids).take(pa.array(tree.order))
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((ids.to_pylist(), points[tree.order].astype("<i4"), tree.levels), 5)], pa.binary())], ["block"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                values = _whole(part["p"].flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)
                while len(values):
                    take = min(len(values), block - n)
                    held.append(values[:take])
                    held_ids.append(part["vec_id"].slice(part.num_rows - len(values), take))
                    values, n = values[take:], n + take
                    if n == block:
                        yield flush()
                        held_ids, held, n = [], [], 0
        if n:
            yield flush()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list]]:
    for batch in batches:
        for blob in batch["block"]:
            ids, points, levels = pickle.loads(blob.as_buffer())
            yield ids, points.astype(np.int64), levels


def _sums(values: list[list[int]], with_distance: bool):
    """Rows (cluster, numbers): members, then sums of components, or of distances in two halves; one a centroid and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, total = Centroids(values), {}
        for _, points, levels in _blocks(batches):
            label, _ = assign(points, levels, centroids)
            if with_distance:
                d = _squares(points, np.array(values, np.int64)[label])
                points = np.stack([d >> 32, d & 0xFFFFFFFF], axis=1)
            rank = np.argsort(label, kind="stable")
            which, first = np.unique(label[rank], return_index=True)
            sums = np.add.reduceat(points[rank], first, axis=0)
            for c, m, s in zip(which.tolist(), np.diff(np.r_[first, len(label)]), sums, strict=True):
                total[c] = total.get(c, 0) + np.r_[m, s]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))], ["cluster", "numbers"])

    return run


def _totals(blocks: DataFrame, values: list[list[int]], with_distance: bool = False) -> dict[int, list[int]]:
    """Sums of all tasks, exact: as many rows as there are centroids and components."""
    parts = blocks.mapInArrow(_sums(values, with_distance), "cluster int, numbers array<long>").select("cluster", F.posexplode("numbers").alias("at", "x"))
    out: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("x")).collect():
        out.setdefault(r["cluster"], {})[r["at"]] = int(r["x"])
    return {c: [x for _, x in sorted(row.items())] for c, row in out.items()}


def _rows(values: list[list[int]], inertia: list[int]):
    names = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, all_ = Centroids(values), np.array(values, np.int64)
        for ids, points, levels in _blocks(batches):
            label, _ = assign(points, levels, centroids)
            own = label.tolist()
            columns = [pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array(_squares(points, all_[label])), pa.array([inertia[c] for c in own], pa.int64()), pa.array([sum(inertia)] * len(own), pa.int64()), pa.array([names[c] for c in own])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3", block: int = BLOCK) -> DataFrame:
    """Clusters of ``vectors`` (vec_id, embedding): a row for each kept vector with its cluster, distance and the sums of distances.

    Only vectors of ``size`` components, none null or non-finite, take part, as integers floor(scale * x); a component
    beyond ``LARGEST`` is an error. Centroids start as the ``k`` vectors with the least SHA-256 of ``seed:vec_id`` (rows of
    one vec_id: the lesser vector first; rows without a vec_id can't start one), or as all vectors if there are fewer.
    A centroid that loses all its vectors stays; repeated rows count as often as they stand; equal centroids give all to
    the smaller number. An empty table gives no rows. Driver and tasks hold ``k`` centroids and a block.
    """
    spark, rows = vectors.sparkSession, kept_vectors(vectors, size, scale)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where(F.col("vec_id").isNotNull()).orderBy(mark, "p").limit(k).select("p").collect()
    values = [[int(x) for x in _whole(np.array(r["p"]))] for r in first]
    if not values:
        return spark.createDataFrame([], OUT)
    blocks = materialise(rows.mapInArrow(_build(size, block), "block binary"))
    for _ in range(rounds):
        for c, (m, *sums) in _totals(blocks, values).items():
            values[c] = [s // m for s in sums]
    found = _totals(blocks, values, with_distance=True)
    inertia = [(found[c][1] << 32) + found[c][2] if c in found else 0 for c in range(len(values))]
    if sum(inertia) >= 1 << 63:
        raise ValueError("the sum of distances exceeds 64 bits")
    return blocks.mapInArrow(_rows(values, inertia), OUT)
