"""Nearest neighbours by largest inner product with a vantage-point tree for each shard.

Inner products order like Euclidean distances once every candidate gets one more coordinate that brings it to the
largest norm, and every query a zero there. Each shard of candidates is one tree: a node keeps a vantage point and the
range of distances to it below each child; by the triangle inequality a child cannot hold anything nearer than the gap
between the query's distance and that range. Children whose gap, times ``factor``, exceeds the distance of the worst
neighbour so far are passed over: 1 gives exact search, more gives up some recall for fewer visits.

Queries travel in blocks. The pairs of shard and block make a grid, cut into tiles of a bounded number of bytes; each
tile is a task that reads its trees and its blocks once and gives on only the best of each query. So a tree is sent once
for each column of tiles, not once for each block.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Candidates in a shard (by a hash of their id), rows of a leaf, queries in a block.
SHARD, LEAF, BLOCK = 16384, 256, 2048
#: Pruning factor of the registered search: recall at 20 was 0.994 or more on tables of 2 to 128 dimensions (normal, clustered, unit and integer vectors).
FACTOR = 1.25
#: Neighbours that a shard's search keeps beyond those asked for, until exact products decide.
SPARE = 8
#: Up to so many pairs of shard and block each is a tile; beyond, tiles grow up to so many bytes of trees and of queries.
TASKS, TILE_BYTES = 4096, (128 << 20, 64 << 20)


class Tree:
    """Vantage-point tree over rows of ``points``: rows are reordered so that every leaf is a slice."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        #: (vantage row, start, end, inner child, outer child, least and largest distance inside, the same outside)
        self.nodes: list[tuple] = []
        if len(points):
            self._build(0, len(points))

    def _build(self, lo: int, hi: int) -> int:
        at = len(self.nodes)
        self.nodes.append((lo, lo, hi, -1, -1, 0.0, 0.0, 0.0, 0.0))
        if hi - lo <= self.leaf:
            return at
        rows = self.order[lo:hi]
        # The row farthest from the first one lies at the rim, where distances spread most.
        far = rows[np.argmax(((self.points[rows] - self.points[rows[0]]) ** 2).sum(axis=1))]
        d = np.sqrt(((self.points[rows] - self.points[far]) ** 2).sum(axis=1))
        half = len(rows) // 2
        part = np.argpartition(d, half)
        self.order[lo:hi], d = rows[part], d[part]
        inner, outer = self._build(lo, lo + half), self._build(lo + half, hi)
        self.nodes[at] = (int(far), lo, hi, inner, outer, float(d[:half].min()), float(d[:half].max()), float(d[half:].min()), float(d[half:].max()))
        return at

    def search(self, vectors: np.ndarray, queries: np.ndarray, k: int, factor: float, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of ``vectors`` with the ``k`` largest inner products with each query, these products (-1 and -inf where
        there are fewer), and the number of products computed; ties go to the smaller row.

        ``points`` are ``vectors`` with the coordinate that makes inner products order like distances. ``skip[i]`` is a row
        that query ``i`` passes over, or -1.
        """
        n = len(queries)
        best, rows, seen = np.full((n, k), -np.inf), np.full((n, k), len(vectors)), 0
        if not len(vectors) or not n:
            return np.full((n, k), -1), best, seen
        # Squared distance: own + whole - 2 * product. Roundings are far below 1e-13 of own + whole.
        own, whole = (queries**2).sum(axis=1), float((self.points[0] ** 2).sum())
        visited = np.zeros((n, len(self.nodes)), bool)

        def reach(q: np.ndarray) -> np.ndarray:
            worst = own[q] + whole - 2 * best[q, -1]
            return np.sqrt(np.maximum(worst, 0) + 1e-13 * (own[q] + whole))

        def leaf(at: int, q: np.ndarray) -> None:
            nonlocal seen
            lo, hi = self.nodes[at][1:3]
            q = q[~visited[q, at]]
            if not len(q):
                return
            visited[q, at] = True
            at_rows = self.order[lo:hi]
            s = queries[q] @ vectors[at_rows].T
            seen += s.size
            if skip is not None:
                s[at_rows[None] == skip[q][:, None]] = -np.inf
            better = (s >= best[q, -1:]).any(axis=1)
            q, s = q[better], s[better]
            if not len(q):
                return
            every, every_rows = np.concatenate([best[q], s], axis=1), np.concatenate([rows[q], np.broadcast_to(at_rows, s.shape)], axis=1)
            top = np.lexsort((every_rows, -every), axis=1)[:, :k]
            best[q], rows[q] = np.take_along_axis(every, top, 1), np.take_along_axis(every_rows, top, 1)

        def gaps(at: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            vantage, *_, a, b, c, e = self.nodes[at]
            d = np.sqrt(((queries[q] - self.points[vantage, :-1]) ** 2).sum(axis=1) + self.points[vantage, -1] ** 2)
            return np.maximum(np.maximum(a - d, d - b), 0), np.maximum(np.maximum(c - d, d - e), 0)

        def down(at: int, q: np.ndarray) -> None:  # first the nearer child alone, for a good bound
            inner, outer = self.nodes[at][3:5]
            if inner < 0:
                return leaf(at, q)
            x, y = gaps(at, q)
            near = x < y
            near |= (x == y) & (q % 2 == 0)
            for child, part in ((inner, q[near]), (outer, q[~near])):
                if len(part):
                    down(child, part)

        def all_(at: int, q: np.ndarray, gap: np.ndarray) -> None:
            open_ = gap * factor <= reach(q)
            q, gap = q[open_], gap[open_]
            if not len(q):
                return
            inner, outer = self.nodes[at][3:5]
            if inner < 0:
                return leaf(at, q)
            x, y = gaps(at, q)
            all_(inner, q, np.maximum(gap, x))
            all_(outer, q, np.maximum(gap, y))

        every = np.arange(n)
        down(0, every)
        all_(0, every, np.zeros(n))
        rows[best == -np.inf] = -1
        return rows, best, seen


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the rows whose vectors are neither null nor zero and hold finite numbers only."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return plain.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _combine(k: int):
    """Vectors of each batch with the ``k + 1`` smallest ids that have them: no result needs more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in sorted(zip(batch["vec_id"].to_pylist(), batch["v"].to_pylist(), strict=True)):
                ids = held.setdefault(np.array(v, "<f8").tobytes(), [])
                if len(ids) <= k and i not in ids[-1:]:
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["v", "ids"])

    return run


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``(v, ids)``: each vector as bytes of doubles, with its ``k + 1`` smallest ids, ascending."""
    parts = rows.mapInArrow(_combine(k), "v binary, ids array<long>")
    return parts.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def _build(largest: float, leaf: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["ids"].to_pylist(), table["v"].to_pylist(), strict=True))
        v = np.array([np.frombuffer(x, "<f8") for _, x in rows])
        last = np.sqrt(np.maximum(largest - (v**2).sum(axis=1), 0))
        tree = Tree(np.concatenate([v, last[:, None]], axis=1), leaf)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps((v, [x for x, _ in rows], tree.order, tree.nodes, last), 5)], pa.binary())})

    return run


def _pack_queries(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    v, ids = _matrix(table["v"]), table["vec_id"].to_numpy()
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "width": pa.array([v.shape[1]], pa.int64()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "queries": pa.array([np.ascontiguousarray(v, "<f8").tobytes()], pa.binary())})


def _first(k: int, at: np.ndarray, near: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query ``at``: largest score first, ties to the smaller id."""
    order = np.lexsort((near, -score, at))
    at, near, score = at[order], near[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], near[keep], score[keep]


def _search(k: int, factor: float, leaf: int):
    def one(tree: Tree, v: np.ndarray, ids: list, alone: dict, own: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Some more than k, so that products that round otherwise in a matrix product find their place by ``score``.
        rows, _, _ = tree.search(v, q, k + SPARE, factor, np.array([alone.get(x, -1) for x in own.tolist()]))
        at, _ = np.nonzero(rows >= 0)
        found = rows[rows >= 0]
        score = (q[at] * v[found]).sum(axis=1)
        many = np.array([len(ids[i]) for i in found.tolist()], np.int64)
        at, score = np.repeat(at, many), np.repeat(score, many)
        near = np.array([x for i in found.tolist() for x in ids[i]], np.int64)
        keep = near != own[at]
        return at[keep], near[keep], score[keep]

    def run(trees: pa.Table, packs: pa.Table) -> pa.Table:
        blocks = []
        if trees.num_rows:
            for width, ids_, queries_ in zip(packs["width"].to_pylist(), packs["ids"], packs["queries"], strict=True):
                blocks.append((np.frombuffer(ids_.as_buffer(), "<i8"), np.frombuffer(queries_.as_buffer(), "<f8").reshape(-1, width)))
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in blocks]
        for tree_ in trees["tree"] if blocks else ():
            v, ids, order, nodes, last = pickle.loads(tree_.as_buffer())
            tree = Tree.__new__(Tree)
            tree.points, tree.leaf, tree.order, tree.nodes = np.concatenate([v, last[:, None]], axis=1), leaf, order, nodes
            alone = {x[0]: i for i, x in enumerate(ids) if len(x) == 1}
            for b, (own, q) in enumerate(blocks):
                best[b] = _first(k, *(np.concatenate(x) for x in zip(best[b], one(tree, v, ids, alone, own, q), strict=True)))
        query = pa.chunked_array([own[at] for (own, _), (at, _, _) in zip(blocks, best, strict=True)], pa.int64())
        return pa.table({"query_id": query, "vec_id": pa.chunked_array([x for _, x, _ in best], pa.int64()), "score": pa.chunked_array([x for _, _, x in best], pa.float64())})

    return run


def tile_sides(shards: int, blocks: int, tree_bytes: int, block_bytes: int, tasks: int = TASKS) -> tuple[int, int]:
    """Shards and blocks of a tile: one each up to ``tasks`` pairs, then more, within TILE_BYTES."""
    grow = -(-shards * blocks // tasks)
    rows = min(shards, max(1, min(math.isqrt(grow - 1) + 1, TILE_BYTES[0] // max(1, tree_bytes))))
    return rows, min(blocks, max(1, min(-(-grow // rows), TILE_BYTES[1] // max(1, block_bytes))))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK, tasks: int = TASKS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` candidates of ``vectors`` with the largest inner product for each of ``queries``.

    Both have vec_id and embedding; a query's own id is no candidate for it. Vectors that are null, zero or hold null or
    non-finite numbers take no part. Scores are inner products in double precision; ties go to the smaller vec_id. Equal
    vectors are one point of a tree, with as many of their smallest ids as a result can hold, so ties among copies are exact
    and a vector with very many copies costs no more than one. Rows of one vec_id and vector count once; a vec_id with
    several vectors is a candidate, and a query, for each of them; vectors of different lengths are an error. Empty tables give no rows.
    """
    rows = usable(vectors)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, largest, width = rows.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    asked = usable(queries).dropDuplicates(["vec_id", "v"])
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked.count() // block))
    high, wide = tile_sides(shards, blocks, shard * 8 * (width or 1), block * 8 * (width or 1), tasks)
    points = distinct_vectors(rows, k).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    trees = points.groupBy("shard").applyInArrow(_build(float(largest or 0), leaf), "shard long, tree binary")
    packs = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").applyInArrow(_pack_queries, "block long, width long, ids binary, queries binary")

    def every(side: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(side)

    down, across = -(-shards // high), -(-blocks // wide)
    parts = max(1, min(2 * down * across, 4096))
    left = trees.select(F.floor(F.col("shard") / high).alias("down"), every("across", across), "tree").repartition(parts, "down", "across")
    right = packs.select(F.floor(F.col("block") / wide).alias("across"), every("down", down), "width", "ids", "queries").repartition(parts, "down", "across")
    found = left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(_search(k, factor, leaf), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
