"""Connected components of an undirected graph by hooking roots and contracting the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save


def _roots(up: DataFrame) -> DataFrame:
    """``node, root``: each node's root where ``up(node, root)`` names its parent."""
    while True:
        of = up.select(F.col("node").alias("parent"), F.col("root").alias("top"))
        jumped = save(up.join(of, F.col("root") == F.col("parent")).select("node", F.col("root").alias("was"), F.col("top").alias("root")), "roots")
        discard(up)
        up = jumped
        if not up.filter(F.col("was") != F.col("root")).limit(1).count():
            return up


def hooked(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``node, component``, each within one component, if not always whole.

    One round: every node goes where the hooks to its least neighbour, and on, end.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    up = _roots(save(near.select("node", F.least("node", "near").alias("root")), "hooks"))
    out = save(up.select("node", F.col("root").alias("component")), "labels")
    discard(up)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``node, component``: the least node reachable, per node of an edge.

    A round hooks each node to its least neighbour if that is less, follows the hooks to their
    ends by pointer jumping, and replaces the ends of the edges by their roots. A root that
    stays has taken in a neighbour within two rounds, so that these are logarithmic in the
    nodes; rounds go on until no edge is left. Tables are written between rounds; the driver
    sees only whether rows are left.
    """
    both = save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = None
    while labels is None or both.limit(1).count():
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        up = _roots(save(near.select("node", F.least("node", "near").alias("root")), "hooks"))
        at = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        left = save(both.join(at("a"), "a").join(at("b"), "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
        if labels is None:
            moved = save(up.select("node", F.col("root").alias("component")), "labels")
            discard(both, up)
        else:
            moved = save(labels.join(at("component"), "component", "left").select("node", F.coalesce("root_component", "component").alias("component")), "labels")
            discard(both, up, labels)
        both, labels = left, moved
    discard(both)
    return labels
