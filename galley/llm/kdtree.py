"""Exact top-k by inner product: a KD-tree per shard, best-first traversal, k-th scores passed on.

Vectors are dealt over shards of bounded size by a hash of their row. A shard's tree splits at medians of the widest
dimension down to small leaves; every node has the tight box of its vectors. For a query, a box bounds the inner product
from above; nodes are visited in order of their bounds until none can reach the k-th best score. Every query first meets
its own shard, and the k-th score found there is where its search of all shards starts. A task builds the tree of a shard
once and takes all queries through it; queries are broadcast in rounds of bounded size, shards stay where they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, saved
from .vectors import LONG, as_longs, by_score, in_rounds, inner, largest, packed, quantized, unpacked

# Numbers in a shard: 8,192 vectors of 64 components, or fewer longer ones.
SHARD = 1 << 19
LEAF = 256


class Tree:
    """KD-tree over the rows of an integer matrix, with tight boxes."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, nos: np.ndarray | None = None):
        nos = ids if nos is None else nos
        self.most = largest(points)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[tuple[int, int]] = []
        order = np.arange(len(ids))
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            me = len(self.rows)
            part = points[order[a:b]]
            self.low.append(part.min(axis=0))
            self.high.append(part.max(axis=0))
            self.rows.append((a, b))
            self.children.append(None)
            if parent >= 0:
                left, right = self.children[parent]
                self.children[parent] = (me, right) if side == 0 else (left, me)
            spread = self.high[me] - self.low[me]
            if b - a > leaf and spread.size and spread.max() > 0:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, spread.argmax()], middle)]
                self.children[me] = (-1, -1)
                stack += [(a, a + middle, me, 0), (a + middle, b, me, 1)]
        self.ids, self.nos, self.points = ids[order], nos[order], points[order]
        self.low_, self.high_ = np.array(self.low), np.array(self.high)

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int, int]]:
        """``(score, id, row)`` of the k best other than the row ``own``, ties to the smaller id; none below ``floor``."""
        # The largest inner product with any point of each box.
        bounds = inner(self.high_, np.maximum(query, 0), self.most) + inner(self.low_, np.minimum(query, 0), self.most)
        best: list[tuple[int, int, int]] = []
        heap = [(-int(bounds[0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else floor
            if kth is not None and -bound < kth:
                break
            if self.children[node] is None:
                a, b = self.rows[node]
                scores = inner(self.points[a:b], query, self.most)
                at = np.flatnonzero(scores >= kth) if kth is not None else np.arange(b - a)
                for s, i, n in zip(scores[at].tolist(), self.ids[a:b][at].tolist(), self.nos[a:b][at].tolist()):
                    if n != own:
                        if len(best) < k:
                            heapq.heappush(best, (s, -i, -n))
                        elif (s, -i, -n) > best[0]:
                            heapq.heapreplace(best, (s, -i, -n))
            else:
                for child in self.children[node]:
                    if kth is None or bounds[child] >= kth:
                        heapq.heappush(heap, (-int(bounds[child]), child))
        return [(s, -i, -n) for s, i, n in best]


FOUND = "no bigint, score bigint, vec_id bigint, found bigint"


def _found(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    nos, scores, ids, found = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(nos), as_longs(scores), pa.array(ids), pa.array(found)], ["no", "score", "vec_id", "found"])


def _tree(batch: pa.RecordBatch, row: int, leaf: int) -> tuple[int, Tree]:
    dims = batch.column("dims")[row].as_py()
    rows, points = unpacked(batch.column("rows")[row], dims)
    ids, nos = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "no"))
    return dims, Tree(ids, points, leaf, nos)


def _own_shard(shards: DataFrame, every: int, k: int, leaf: int) -> DataFrame:
    """What every query finds in the shard that it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, tree = _tree(batch, row, leaf)
                out = []
                for at in np.flatnonzero(tree.ids % every == 0).tolist():
                    no = int(tree.nos[at])
                    out += [(no, *hit) for hit in tree.search(tree.points[at], no, k, None)]
                if out:
                    yield _found(out)
        give_back()

    return shards.mapInArrow(run, FOUND)


def _searched(shards: DataFrame, asked: DataFrame, k: int, leaf: int) -> DataFrame:
    """``asked`` (``no, dims, v, floor``) in all shards, none below ``floor``."""

    def search(batches: Iterator[pa.RecordBatch], queries: pa.Table) -> Iterator[pa.RecordBatch]:
        by_dims: dict[int, list] = {}
        for no, dims, v, floor in zip(*[queries.column(c).to_pylist() for c in ("no", "dims", "v", "floor")]):
            by_dims.setdefault(dims, []).append((no, np.array(v, np.int64), floor))
        for batch in batches:
            for row in range(batch.num_rows):
                dims, tree = _tree(batch, row, leaf)
                out = []
                for no, query, floor in by_dims.get(dims, []):
                    out += [(no, *hit) for hit in tree.search(query, no, k, floor)]
                    if len(out) > 1 << 16:
                        yield _found(out)
                        out = []
                if out:
                    yield _found(out)
        give_back()

    return in_rounds(shards.select("dims", "rows"), asked.select("no", "dims", "v", "floor"), search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("no").orderBy(*by_score("vec_id", "found"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    k: int = 5,
    scale: int = 256,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard: int = SHARD,
    leaf: int = LEAF,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other vectors for each whose id is divisible by ``every``.

    Vectors that are null or hold a null or non-finite component take no part, nor do null ids. Vectors only meet those
    of their own length. Every row counts, also where an id or a whole row repeats: each is a candidate for all rows but
    itself, and a query id that occurs twice is asked twice. Equal scores go to the smaller id. A query with fewer candidates
    has them all. Components beyond 2^62 after scaling count as 2^62, and scores that do not fit a long are cut to its ends. An
    empty table gives no rows.
    """
    rows = saved(quantized(vectors, id_col, vector_col, scale), "vectors").df
    numbers = rows.agg(F.coalesce(F.sum("dims"), F.lit(0))).first()[0]
    shards = max(1, -(-numbers // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("no"), F.lit(shards)).cast("int"))
    shards = saved(packed(dealt, ["dims", "shard"], ["no", "vec_id", "v"]), "shards").df
    first = saved(_own_shard(shards, every, k, leaf), "seeds").df
    floors = first.groupBy("no").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    # A score that was cut to the least long bounds nothing.
    floors = floors.where(F.col("kth") > -LONG - 1).select(F.col("no").alias("f"), F.col("kth").alias("floor"))
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = saved(asked.join(floors, F.col("no") == F.col("f"), "left").select("no", "vec_id", "dims", "v", "floor"), "queries").df
    found = _best(_searched(shards, queries, k, leaf), k)
    named = queries.select(F.col("no").alias("q"), F.col("vec_id").alias("query_id"))
    return found.join(named, F.col("no") == F.col("q")).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
