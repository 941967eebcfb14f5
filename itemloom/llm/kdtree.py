"""Exact top-k by inner product: a KD-tree per shard, searched best first.

Vectors are dealt to shards by hash, and one task builds each shard's tree: nodes are split
at the median of their widest dimension, each with its tight bounding box, down to leaves.
No point of a box scores more against a query than the sum over dimensions of the larger of
query times lower and query times upper bound, so a search takes nodes in descending order
of that bound and stops below the k-th score it holds.

The search has two waves.  In the first each query visits one shard only, which gives a
k-th score; the second visits the other shards with that score as the bar, so whole shards
and subtrees below it are left out.  Queries travel in blocks of a fixed size, shards have a
fixed size too, so a task holds one tree and one block at a time, at any corpus size.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.shared import bounded_batches, materialised

#: Vectors of a shard and of a leaf, and queries of a block.
SHARD, LEAF, BLOCK = 20_000, 256, 512
#: Factor by which components become integers.
SCALE = 1024

FOUND = "query_id bigint, block bigint, vec_id bigint, score bigint"


class Tree:
    """Integer vectors in the order of the tree, boxes of its nodes, and where each node's rows lie."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.rows: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            begin, end, parent, side = waiting.pop()
            own = points[order[begin:end]]
            node = len(self.rows)
            self.low.append(own.min(0))
            self.high.append(own.max(0))
            self.rows.append((begin, end))
            self.children.append(None)
            if parent >= 0:
                pair = list(self.children[parent] or (0, 0))
                pair[side] = node
                self.children[parent] = tuple(pair)
            if end - begin > LEAF and (self.low[node] < self.high[node]).any():
                widest = int(np.argmax(self.high[node].astype(np.float64) - self.low[node]))
                middle = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, widest], middle)]
                waiting += [(begin, begin + middle, node, 0), (begin + middle, end, node, 1)]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def packed(self) -> bytes:
        return pickle.dumps(vars(self), 5)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(data))
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, a number that no score in the node exceeds."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return exact_products(plus, self.high) + exact_products(minus, self.low)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, bars: list[tuple | None]) -> list[list[tuple[int, int]]]:
        """The k best (score, -vec_id) of each query that reach its bar, the query's own id left out."""
        out = []
        for query_id, query, row, bar in zip(query_ids, queries, self.bounds(queries), bars):
            best: list[tuple[int, int]] = []
            heap = [(-int(row[0]), 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                least = best[0][0] if len(best) == k else None
                if bar is not None:
                    least = bar if least is None else max(least, bar)
                if least is not None and -bound < least:
                    break
                if self.children[node] is not None:
                    for child in self.children[node]:
                        heapq.heappush(heap, (-int(row[child]), child))
                    continue
                begin, end = self.rows[node]
                scores = exact_products(query[None, :], self.points[begin:end])[0]
                keep = np.flatnonzero((self.ids[begin:end] != query_id) & (scores >= (least if least is not None else scores.min())))
                for score, own in zip(scores[keep].tolist(), self.ids[begin:end][keep].tolist()):
                    item = (score, -own)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            out.append(best)
        return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows: by floating point only where every sum is exact in it."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _vectors(column: Iterable) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in column], np.int64).reshape(len(column), -1)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and point of the vectors that take part: no null vector or component, all finite."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(usable & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x * SCALE).cast("bigint")).alias("point"))


def _search_pairs(k: int, first: bool, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for tree_bytes, block, rows in zip(batch["tree"], batch["block"], batch["queries"]):
            tree = Tree.unpacked(tree_bytes)
            ids = np.array([r["query_id"] for r in rows], np.int64)
            points = _vectors([r["point"] for r in rows])
            bars = [None if first or r["bar"] is None or r["bar"] != r["bar"] else int(r["bar"]) for r in rows]
            found = tree.search(ids, points, k, bars)
            flat = [(int(q), int(block), -own, score) for q, best in zip(ids, found) for score, own in best]
            if flat:
                yield pd.DataFrame(flat, columns=["query_id", "block", "vec_id", "score"])


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query, ties to the smaller vec_id.

    Queries are rows whose vec_id is divisible by ``every``; candidates are all rows with
    another vec_id.  Vectors meet those of their own length only.  Vectors that are null or
    hold null or non-finite components, and rows without a vec_id, take no part; rows that
    repeat a vec_id each count, a repeated query is asked once; an empty table gives no
    rows; other columns are not read.  Scores are exact while they fit 64 bits.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    vectors = integer_vectors(embeddings).withColumn("length", F.size("point"))
    count = vectors.groupBy("length").count()
    sized = vectors.join(F.broadcast(count.select(F.col("length").alias("own"), F.ceil(F.col("count") / shard).alias("shards"))), F.col("length") == F.col("own"))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        tree = Tree(rows["vec_id"].to_numpy(np.int64), _vectors(rows["point"]))
        return pd.DataFrame({"length": rows["length"].iloc[:1], "part": rows["part"].iloc[:1], "tree": [tree.packed()]})

    trees = materialised(
        dealt.select("length", "part", "vec_id", "point").groupBy("length", "part").applyInPandas(build, "length int, part bigint, tree binary"), "trees"
    )
    asked = (
        vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "length", "point"])
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 40)))
    )
    blocks = asked.groupBy("length").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = asked.join(F.broadcast(blocks.withColumnRenamed("length", "own")), F.col("length") == F.col("own")).withColumn("block", F.col("block") % F.col("blocks"))

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.groupBy("length", "block").agg(F.collect_list(F.struct(F.col("vec_id").alias("query_id"), "point", "bar")).alias("queries"))

    # A block's first shard is given by its number, so first visits spread over all shards.
    sizes = trees.groupBy("length").agg(F.max("part").alias("last")).withColumnRenamed("length", "own")
    waiting = in_blocks(asked.withColumn("bar", F.lit(None).cast("bigint"))).join(F.broadcast(sizes), F.col("length") == F.col("own")).drop("own")
    first = waiting.withColumn("part", F.pmod("block", F.col("last") + 1)).join(trees, ["length", "part"])
    found = materialised(first.select("tree", "block", "queries").mapInPandas(lambda b: _search_pairs(k, True, b), FOUND), "first-wave")
    bars = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
    again = in_blocks(asked.join(bars.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")).join(F.broadcast(sizes), F.col("length") == F.col("own")).drop("own")
    rest = again.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).filter(F.col("part") != F.pmod("block", F.col("last") + 1))
    more = rest.join(trees, ["length", "part"]).select("tree", "block", "queries").mapInPandas(lambda b: _search_pairs(k, False, b), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS p FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.p, c.p) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
