"""Exact top-k search by inner product: a ball tree for every shard of vectors, branch and bound.

Vectors are dealt to shards of about ``SHARD_VALUES`` components and each shard's ball tree is written once, as a row of arrays.
Queries come in blocks, each broadcast and run against every shard in two waves. The first visits, in each shard, only the
most promising leaf of a query; the k-th best score over all shards is then known to be reached. The second wave starts
from that shared score: nodes are opened in order of the bound q.c + |q| r on their inner products, and a node whose bound
is below the current k-th score is dropped with everything under it. Ties must survive, so bounds are compared strictly
and with a margin for rounding; scores themselves are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.rows import numbered
from ledgerloom.session import cut

SHARD_VALUES = 1 << 20
LEAF_ROWS = 64
#: Queries of one broadcast hold at most this many components, 32 MB.
BLOCK_VALUES = 4 << 20
#: Queries handled together.
GROUP = 256
#: Whole numbers up to here are exact as floats.
EXACT = 1 << 53


def _scaled(scale: int):
    """Vectors with finite components as whole numbers, others left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, vectors, sizes = [], [], []
            for key, vector in zip(rows.column("vec_id").to_pylist(), rows.column("vector")):
                if key is None or not vector.is_valid or vector.values.null_count:
                    continue
                values = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(values).all():
                    with np.errstate(over="ignore"):
                        whole = np.nan_to_num(np.floor(values * scale), posinf=np.finfo(float).max, neginf=np.finfo(float).min)
                    ids.append(key)
                    vectors.append(whole)
                    sizes.append(len(whole))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = np.concatenate([np.empty(0), *vectors])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                ["vec_id", "size", "vector"],
            )

    return run


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


class BallTree:
    """Nodes are halves of halves: node i covers rows[begin[i]:end[i]] and has children 2 i + 1 and 2 i + 2."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        depth = max(0, math.ceil(math.log2(max(1, n / LEAF_ROWS))))
        nodes = (1 << depth + 1) - 1
        self.order, self.leaves = np.arange(n), (1 << depth) - 1
        self.begin, self.end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.center, self.radius = np.zeros((nodes, vectors.shape[1])), np.zeros(nodes)
        self.end[0] = n
        # The largest float squares would overflow; such vectors get an infinite radius and are never dropped.
        with np.errstate(over="ignore", invalid="ignore"):
            for node in range(nodes):
                begin, end = self.begin[node], self.end[node]
                own = vectors[self.order[begin:end]]
                if len(own):
                    self.center[node] = own.mean(0)
                    far = np.sqrt(((own - self.center[node]) ** 2).sum(1))
                    self.radius[node] = np.nan_to_num(far.max(), nan=np.inf)
                if node >= self.leaves:
                    continue
                middle = begin + (end - begin + 1) // 2
                if len(own) > 1:
                    # Split across the line from the farthest row to the row farthest from that.
                    one = own[int(np.nan_to_num(far).argmax())]
                    two = own[int(np.nan_to_num(((own - one) ** 2).sum(1)).argmax())]
                    side = np.nan_to_num(own @ (two - one))
                    self.order[begin:end] = self.order[begin:end][np.argpartition(side, middle - begin - 1)]
                left, right = 2 * node + 1, 2 * node + 2
                self.begin[left], self.end[left], self.begin[right], self.end[right] = begin, middle, middle, end

    FIELDS = ("order", "begin", "end", "center", "radius")

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in self.FIELDS}

    @classmethod
    def unpacked(cls, row: dict, size: int) -> BallTree:
        tree = object.__new__(cls)
        for name in cls.FIELDS:
            kind = np.int64 if name in ("order", "begin", "end") else np.float64
            setattr(tree, name, np.frombuffer(row[name], kind))
        tree.leaves = (len(tree.begin) - 1) // 2
        tree.center = tree.center.reshape(len(tree.begin), size)
        return tree


_INDEX = "shard int, size int, vec_ids binary, vectors binary, " + ", ".join(f"`{f}` binary" for f in BallTree.FIELDS)


def _index(group: pa.Table) -> pa.Table:
    size = group.column("size")[0].as_py()
    vectors, ids = _matrix(group.column("vector"), size), group.column("vec_id").to_numpy()
    tree = BallTree(vectors)
    row = {"shard": group.column("shard")[0].as_py(), "size": size}
    # Rows are stored in tree order, so a leaf is one block of the matrix.
    row |= {"vec_ids": ids[tree.order].tobytes(), "vectors": vectors[tree.order].tobytes()} | tree.packed()
    kinds = [("shard", pa.int32()), ("size", pa.int32())] + [(k, pa.binary()) for k in list(row)[2:]]
    return pa.Table.from_pylist([row], schema=pa.schema(kinds))


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; ones beyond 64 bits become the nearest 64-bit number."""
    top = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if top < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = big(queries) @ big(vectors).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class _Best:
    """The best k (score, smaller id first) of some queries, among what reaches their known k-th score."""

    def __init__(self, k: int, own: np.ndarray, floor: np.ndarray):
        self.k, self.own, self.floor = k, own, floor.copy()
        self.parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        self.waiting = 0

    def add(self, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores of the queries ``rows`` with the vectors ``keys``; a query is no partner of itself."""
        reach = (scores >= self.floor[rows][:, None]) & (keys != self.own[rows][:, None])
        at = np.nonzero(reach)
        if len(at[0]):
            self.parts.append((rows[at[0]], scores[at], keys[at[1]]))
            self.waiting += len(at[0])
            if self.waiting > 16 * self.k * len(self.own) + (1 << 16):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps the best k of each query, and raises the floors of those that have k."""
        row, score, key = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((key, ~score, row))
        row, score, key = row[order], score[order], key[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])
        keep = place < self.k
        self.parts, self.waiting = [(row[keep], score[keep], key[keep])], 0
        return self.parts[0]


def _search(block, k: int, whole: bool):
    """Searches a shard for the queries of a block: their best leaf only, or everything their known k-th score allows."""

    def one(row: dict) -> Iterator[pa.RecordBatch]:
        ids, vectors, floors = (block.value[x].get(row["size"]) for x in ("ids", "vectors", "floors"))
        if ids is None:
            return
        size = row["size"]
        held, keys = np.frombuffer(row["vectors"], np.float64), np.frombuffer(row["vec_ids"], np.int64)
        held, tree = held.reshape(len(keys), size), BallTree.unpacked(row, size)
        best = _Best(k, ids, floors)
        with np.errstate(over="ignore", invalid="ignore"):
            length, spread = np.sqrt((vectors**2).sum(1)), np.abs(tree.center).sum(1) + tree.radius

        def bounds(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            """Upper bounds on the inner products of each query (rows) with what lies under each node (columns)."""
            with np.errstate(over="ignore", invalid="ignore"):
                value = vectors[rows] @ tree.center[nodes].T + length[rows, None] * tree.radius[nodes]
                margin = 1e-9 * length[rows, None] * spread[nodes] + 1e-6
            return np.nan_to_num(value + margin, nan=np.inf)

        def open_leaves(rows: np.ndarray, leaves: np.ndarray) -> None:
            order = np.argsort(leaves, kind="stable")
            rows, leaves = rows[order], leaves[order]
            starts = np.flatnonzero(np.concatenate([[True], leaves[1:] != leaves[:-1]])) if len(leaves) else []
            for start, end in zip(starts, [*starts[1:], len(leaves)]):
                at = slice(tree.begin[leaves[start]], tree.end[leaves[start]])
                if at.start < at.stop:
                    best.add(rows[start:end], _scores(vectors[rows[start:end]], held[at]), keys[at])
            best.settle()

        for begin in range(0, len(ids), GROUP):
            rows = np.arange(begin, min(begin + GROUP, len(ids)))
            if not whole:
                # Down to the child of the larger bound.
                node = np.zeros(len(rows), np.int64)
                while (node < tree.leaves).any():
                    left = 2 * node + 1
                    level = np.arange(left.min(), left.max() + 2)
                    bound = bounds(rows, level)
                    at = np.arange(len(rows)), left - level[0]
                    node = np.where(bound[at] >= bound[at[0], at[1] + 1], left, left + 1)
                open_leaves(rows, node)
                continue
            # Level by level, nodes whose bound is below the k-th score go with all that is under them.
            open_ = np.ones((len(rows), 1), bool)
            level = np.zeros(1, np.int64)
            while level[0] < tree.leaves:
                level = np.arange(2 * level[0] + 1, 2 * level[-1] + 3)
                bound = bounds(rows, level)
                open_ = np.repeat(open_, 2, axis=1) & (bound >= best.floor[rows][:, None])
            bound = np.where(open_, bounds(rows, level), -np.inf)
            # Leaves in the order of their bounds, a few first and then more, as each batch may raise the k-th score.
            ranked, done, batch = np.argsort(-bound, axis=1, kind="stable"), 0, 2
            while done < len(level):
                pick = ranked[:, done : done + batch]
                value = np.take_along_axis(bound, pick, axis=1)
                now = np.nonzero((value > -np.inf) & (value >= best.floor[rows][:, None]))
                if not len(now[0]):
                    break
                open_leaves(rows[now[0]], level[pick[now]])
                done, batch = done + batch, batch * 4
        row_of, score, key = best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row_of]), pa.array(key), pa.array(score)], ["query_id", "vec_id", "score"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                yield from one(row)

    return run


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _by_size(rows: list, floors: dict) -> dict[str, dict[int, np.ndarray]]:
    out: dict[str, dict[int, np.ndarray]] = {"ids": {}, "vectors": {}, "floors": {}}
    for size in {r["size"] for r in rows}:
        own = [r for r in rows if r["size"] == size]
        out["ids"][size] = np.array([r["vec_id"] for r in own], np.int64)
        out["vectors"][size] = np.array([r["vector"] for r in own], np.float64).reshape(len(own), size)
        out["floors"][size] = np.array([floors.get(r["vec_id"], np.iinfo(np.int64).min) for r in own], np.int64)
    return out


def top_k(
    vectors: DataFrame, queries, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vector for which the column ``queries`` holds, the ``k`` best others.

    Components x become floor(scale * x). The score is the whole inner product; equal scores go to the smaller vec_id. A
    query with fewer than ``k`` others of its length has them all. Vectors that are NULL, hold NULL or non-finite
    components, or have no vec_id take no part. Every other row counts, also those that share a vec_id: each is a candidate
    of all rows but itself, and a query of its own. Vectors of different lengths are not compared; empty vectors score 0 with one another. Other columns are ignored.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    usable = given.mapInArrow(_scaled(scale), "vec_id bigint, size int, vector array<double>")
    # Rows are known by their place in the order of vec_id, which also settles ties.
    placed = numbered(usable, [], [F.col("vec_id").asc(), F.xxhash64("vector").asc()], "place")
    held = cut(placed.withColumnsRenamed({"vec_id": "own_id", "place": "vec_id"}), "vectors")
    shards = max(1, -(-(held.agg(F.sum(F.col("size") + 1)).first()[0] or 0) // SHARD_VALUES))
    dealt = held.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    index = cut(dealt.drop("own_id").groupBy("shard", "size").applyInArrow(_index, _INDEX), "ball_trees")
    named = held.select(F.col("own_id").alias(vec_id), F.struct("vec_id", "size", "vector").alias("row"))
    wanted = cut(named.where(queries).select("row.*"), "queries")
    values = wanted.agg(F.sum(F.col("size") + 2)).first()[0] or 0
    blocks = max(1, -(-values // BLOCK_VALUES))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    results = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == block).collect()
        first = spark.sparkContext.broadcast(_by_size(rows, {}))
        near = index.mapInArrow(_search(first, k, False), _FOUND)
        kth = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", "score")
        floors = {r[0]: r[1] for r in kth.collect()}
        second = spark.sparkContext.broadcast(_by_size(rows, floors))
        found = index.mapInArrow(_search(second, k, True), _FOUND)
        best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        best = cut(best.select("query_id", "rank", "vec_id", "score"), "found") if blocks > 1 else best
        results = best if results is None else results.unionByName(best)
    ids = held.select("vec_id", "own_id")
    own = results.join(ids.toDF("query_id", "query"), "query_id").join(ids, "vec_id")
    return own.select(F.col("query").alias("query_id"), "rank", F.col("own_id").alias("vec_id"), "score")
