"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are dealt to shards of bounded size.  A task builds the tree of a shard by median splits, every node with the
tight box of its points, and sends blocks of queries through it, best node first: the most a query can score in a box
is known from the box alone, and a node is left out for the queries whose k-th score so far is beyond that.  Each
shard's best are then merged per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlight.llm.base import columns_of, table

#: Vectors of a shard, points of a leaf, queries that go through a tree together.
SHARD, LEAF, BLOCK = 4096, 256, 512


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    points: np.ndarray | None = None  # of a leaf: rows of the shard
    children: tuple[Node, Node] | None = None


def build(vectors: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Median splits on the widest side; equal points are halved all the same, so depth is logarithmic."""
    rows = np.arange(len(vectors)) if rows is None else rows
    own = vectors[rows]
    node = Node(own.min(axis=0), own.max(axis=0))
    if len(rows) <= leaf:
        node.points = rows
        return node
    side = int((node.high - node.low).argmax()) if own.shape[1] else 0
    half = len(rows) // 2
    order = np.argpartition(own[:, side], half) if own.shape[1] else np.arange(len(rows))
    node.children = build(vectors, rows[order[:half]], leaf), build(vectors, rows[order[half:]], leaf)
    return node


class Best:
    """The k best of each query of a block: score, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0, np.float64)
        self.id = np.empty(0, np.int64)
        self.kth = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        keep = rank < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        last = rank[keep] == self.k - 1
        self.kth[self.query[last]] = self.score[last]


def search(root: Node, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Best:
    """Best-first traversal for a block of queries; equal scores may still win by id, so only less is left out."""
    best = Best(len(queries), k)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)

    def bound(node: Node, active: np.ndarray) -> np.ndarray:
        return up[active] @ node.high + down[active] @ node.low

    everyone = np.arange(len(queries))
    first = bound(root, everyone)
    heap = [(-float(first.max(initial=-np.inf)), 0, root, everyone, first)]
    serial = 1
    while heap:
        _, _, node, active, most = heapq.heappop(heap)
        open_ = most >= best.kth[active]
        active = active[open_]
        if not len(active):
            continue
        if node.children:
            for child in node.children:
                own = bound(child, active)
                heapq.heappush(heap, (-float(own.max()), serial, child, active, own))
                serial += 1
            continue
        scores = queries[active] @ vectors[node.points].T
        own_ids = ids[node.points]
        good = (scores >= best.kth[active][:, None]) & (own_ids[None, :] != query_ids[active][:, None])
        q, p = good.nonzero()
        best.add(active[q], scores[q, p], own_ids[p])
    return best


def _arrays(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _exact(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether every sum of products is a whole number that a double holds."""
    if not queries.size or not vectors.size:
        return True
    return float(np.abs(queries.astype(float)).max()) * float(np.abs(vectors.astype(float)).max()) * queries.shape[1] < 2**53


def top_k(vectors: DataFrame, is_query, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every query with all other vectors.

    ``is_query`` is a condition on ``vec_id``.  Components become floor(scale * x); vectors that are null, or hold a
    null or a component that is not finite, and rows without id take no part.  Shorter vectors count as followed by
    zeros.  Ties go to the smaller id; a query meets all vectors of another id, repeated rows each for itself.

    Every shard has at most about ``shard`` vectors whatever their values, and meets the queries as a stream: neither
    is ever held whole in a task.  Queries are repeated once per shard, as an exact search over all rows needs.
    """
    own = columns_of(vectors, {"vec_id": id_col, "v": vector_col}).where("vec_id is not null and v is not null")
    finite = own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))))
    whole = finite.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    n, width = finite.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0
    shards = max(1, -(-n // shard))
    padded = whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    points = padded.select(F.pmod(F.xxhash64("vec_id", F.hash("v")), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    queries = padded.where(is_query).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v"
    )
    schema = pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")])

    # Scores are whole numbers and doubles hold them exactly, which is checked for every block.
    def found(tree: tuple, ids: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        root, points, point_ids = tree
        if not _exact(block, points):
            raise OverflowError("components are too large for exact products")
        best = search(root, points, point_ids, block.astype(np.float64), ids, k)
        columns = ids[best.query], best.id, best.score.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tree, current = None, None
        for batch in batches:
            shard_of = batch.column(0).to_numpy()
            kind = batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(kind) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(start, end - start)
                if shard_of[start] != current:
                    held, tree, current = [], None, shard_of[start]
                ids, values = part.column(2).to_numpy(), _arrays(part, width)
                if kind[start] == 0:
                    held.append((ids, values))
                    continue
                if not held:
                    continue
                if tree is None:
                    point_ids = np.concatenate([h[0] for h in held])
                    points = np.concatenate([h[1] for h in held]).astype(np.float64)
                    tree = build(points), points, point_ids
                for at in range(0, len(ids), BLOCK):
                    yield from found(tree, ids[at : at + BLOCK], values[at : at + BLOCK])

    dealt = points.unionByName(queries).repartition("shard").sortWithinPartitions("shard", "kind", "vec_id")
    nearest = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op5_kdtree_topk": op5_kdtree_topk}
#: Vectors as lists of whole numbers, then all products of queries and others.
SQL = {
    "op5_kdtree_topk": """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v::DOUBLE[], p.v::DOUBLE[])::BIGINT AS score
        FROM whole q JOIN whole p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
}
