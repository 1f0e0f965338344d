"""Exact top-k inner-product search by branch and bound over ball trees, one a shard.

Vectors are dealt to shards of bounded size; each shard's task builds a ball tree. Queries
form blocks. A first pass takes every block to every shard and looks only into the leaf with
the highest bound; the k-th best score that a query has found over all shards is a floor
that the second pass shares with all of them. There a query opens nodes in order of the
bound ``q . centre + |q| * radius`` until no bound reaches the better of that floor and its
own k-th score.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, save

_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_HIT_DDL = "query_id long, vec_id long, score long"
_EXACT = 2.0**53
_LEAST, _MOST = -(2**63), 2**63 - 1


class BallTree:
    """A ball tree over distinct integer vectors of one length, each with its ids.

    Of equal vectors only ids that can reach a top k are kept: the ``k + 1`` least (one may
    be the query's own), each at most ``k`` times.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, leaf: int):
        distinct, group = np.unique(vectors, axis=0, return_inverse=True)
        members: list[list[int]] = [[] for _ in distinct]
        for at in np.lexsort((ids, group)):
            own = members[group[at]]
            new = not own or own[-1] != ids[at]
            if new and len(set(own)) <= k or not new and own.count(ids[at]) < k:
                own.append(int(ids[at]))
        order, self.nodes = np.arange(len(distinct)), []
        self._split(distinct, order, 0, len(order), leaf)
        self.vectors, self.members = distinct[order], [members[i] for i in order]
        self.largest = float(np.abs(distinct).max(initial=0.0))

    def _split(self, vectors: np.ndarray, order: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        own = vectors[order[lo:hi]]
        centre = own.mean(axis=0)
        apart = np.sqrt(((own - centre) ** 2).sum(axis=1))
        at = len(self.nodes)
        self.nodes.append(None)
        left = right = -1
        if hi - lo > leaf:
            far = own[apart.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            side = np.argsort(own @ (other - far), kind="stable")
            order[lo:hi] = order[lo:hi][side]
            middle = (lo + hi) // 2
            left, right = self._split(vectors, order, lo, middle, leaf), self._split(vectors, order, middle, hi, leaf)
        self.nodes[at] = (centre, float(apart.max()), lo, hi, left, right)
        return at

    def _scores(self, lo: int, hi: int, query: np.ndarray) -> list[int]:
        if self.largest * float(np.abs(query).max(initial=0.0)) * len(query) < _EXACT:
            return (self.vectors[lo:hi] @ query).astype(np.int64).tolist()
        whole = [int(x) for x in query]
        return [min(max(sum(int(a) * b for a, b in zip(v, whole, strict=True)), _LEAST), _MOST) for v in self.vectors[lo:hi]]

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int | None, first_leaf_only: bool) -> list[tuple[int, int]]:
        """Up to ``k`` pairs ``(score, -vec_id)``; all that could be among the k best over ``floor``."""
        norm = float(np.sqrt(query @ query))

        def bound(node: int) -> float:
            centre, radius = self.nodes[node][:2]
            value = float(centre @ query) + norm * radius
            return max(value + 1e-9 * (abs(value) + norm * (radius + self.largest)) + 1e-6, float(_LEAST))

        best: list[tuple[int, int]] = []
        queue = [(-bound(0), 0)]
        while queue:
            over, node = heapq.heappop(queue)
            least = best[0][0] if len(best) == k else None
            least = floor if least is None else least if floor is None else max(least, floor)
            if least is not None and -over < least:
                break
            _, _, lo, hi, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(queue, (-bound(left), left))
                heapq.heappush(queue, (-bound(right), right))
                continue
            for at, score in enumerate(self._scores(lo, hi, query), lo):
                if least is not None and score < least:
                    continue
                for vec_id in self.members[at]:
                    if vec_id != query_id:
                        if len(best) < k:
                            heapq.heappush(best, (score, -vec_id))
                        elif (score, -vec_id) > best[0]:
                            heapq.heapreplace(best, (score, -vec_id))
            if first_leaf_only:
                break
        return best


def _build(k: int, leaf: int):
    def build(table: pa.Table) -> pa.Table:
        by_length: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for vec_id, vector in zip(table["vec_id"].to_pylist(), table["vector"].to_pylist(), strict=True):
            ids, vectors = by_length[len(vector)]
            ids.append(vec_id)
            vectors.append(vector)
        trees = {n: BallTree(np.array(ids), np.array(vectors, np.float64).reshape(len(ids), n), k, leaf) for n, (ids, vectors) in by_length.items()}
        return pa.table({"shard": table["shard"].slice(0, 1), "trees": pa.array([pickle.dumps(trees)], pa.binary())})

    return build


def _gather(table: pa.Table) -> pa.Table:
    rows = list(zip(table["vec_id"].to_pylist(), table["vector"].to_pylist(), strict=True))
    return pa.table({"block": table["block"].slice(0, 1), "queries": pa.array([pickle.dumps(rows)], pa.binary())})


def _search(k: int, first_leaf_only: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                trees, queries = pickle.loads(batch["trees"][at].as_py()), pickle.loads(batch["queries"][at].as_py())
                floors = {} if first_leaf_only else dict(batch["floors"][at].as_py() or [])
                hits = []
                for query_id, vector in queries:
                    if tree := trees.get(len(vector)):
                        hits += [(query_id, -minus, score) for score, minus in tree.search(query_id, np.array(vector, np.float64), k, floors.get(query_id), first_leaf_only)]
                columns = zip(*hits, strict=True) if hits else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_HIT)

    return search


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, scale: float = 1024.0, shard_rows: int = 16_384, block_rows: int = 16_384, leaf: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest scores, all if fewer.

    Both tables have ``vec_id`` and ``embedding``. Components become ``floor(scale * x)``,
    x as double; scores are exact integer inner products, held to the range of 64 bits: a
    score beyond it is the nearest that a long has. Ties go to the smaller vec_id.
    Candidates are all rows of ``vectors`` but those with the query's own id, of the same
    vector length. Rows whose id or vector is null, or whose vector holds null, NaN or an
    infinity, take no part; an empty vector scores 0 against empty vectors. Repeated rows
    are candidates as often as they occur; a repeated query is answered once, with the
    vector of its largest row. Other columns are not read. Without rows or queries there
    are no rows.

    Every query has to meet every shard, so each shard's tree is read by each block of
    queries: work grows with queries times shards, and pruning is what lowers it. What moves
    is least where a tree and a block are of one size, as they are here. No task holds more
    than one tree and one block. The k-th score is shared once, after the first pass.
    """
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    clean = lambda df: df.filter(sound).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["vector"]
            flat = np.floor(scale * np.asarray(lists.flatten()))
            whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], whole], names=["vec_id", "vector"])

    rows = clean(vectors).mapInArrow(floored, "vec_id long, vector array<double>")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    trees = save(dealt.groupBy("shard").applyInArrow(_build(k, leaf), "shard long, trees binary"), "trees")
    asked = clean(queries).mapInArrow(floored, "vec_id long, vector array<double>").groupBy("vec_id").agg(F.max("vector").alias("vector"))
    asked = save(asked, "queries")
    blocks = max(1, math.ceil(asked.count() / block_rows))
    asked_blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    packed = save(asked_blocks.groupBy("block").applyInArrow(_gather, "block long, queries binary"), "blocks")

    def every_shard(block_table: DataFrame) -> DataFrame:
        spread = block_table.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
        met = trees.join(spread, "shard")
        return met.repartition(min(shards * blocks, 4096), "shard", "block") if shards * blocks > 1 else met

    best = lambda hits: hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    first = save(every_shard(packed).select("trees", "queries").mapInArrow(_search(k, True), _HIT_DDL), "first")
    kth = best(first).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    floors = kth.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("query_id", "floor")).alias("pairs"))
    shared = save(packed.join(floors, "block", "left").select("block", "queries", F.map_from_entries("pairs").alias("floors")), "floors")
    hits = every_shard(shared).select("trees", "queries", "floors").mapInArrow(_search(k, False), _HIT_DDL)
    out = save(best(hits).select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "hits")
    discard(trees, asked, packed, first, shared)
    return out
