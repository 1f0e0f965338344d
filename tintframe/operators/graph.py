"""Connected components of an undirected graph, as joins-free rounds of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to the least node that it or a neighbour of it is."""
    both = edges.union(edges.select("graph", F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least("u", F.min("v").over(W.partitionBy("graph", "u")))
    return both.withColumn("m", least).filter("v > u and v > m").select("graph", F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the least of these."""
    least = F.min("v").over(W.partitionBy("graph", "u"))
    tied = edges.withColumn("m", least).select("graph", F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return tied.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """graph, node, root: each node of ``edges(graph, u, v)`` that is not the least of its component.

    Nodes are longs, told apart within their graph only. Rounds of a large and a small star end
    when every edge leads to the least node of its component, after some ``log(n) ** 2`` rounds
    at most. A node with many neighbours is a window's partition, which Spark sorts and spills.
    Each round is a written table, so that a loss repeats one round.
    """
    ordered = edges.filter("u <> v").select("graph", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.save(ordered, "edges")
    state = _state(now)
    while state[0]:
        following = scratch.save(_small_star(_large_star(now)), "edges")
        before, state = state, _state(following)
        now = following
        if state == before:
            break
    return now.select("graph", F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """What tells whether a round changed anything: number of edges and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("graph", "u", "v").cast("decimal(38,0)"))).first())
