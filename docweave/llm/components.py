"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _minimum_of_neighbours(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours. Combined before the shuffle, so a node
    with very many neighbours is no burden to one task."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("least"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's greater neighbours go to its least neighbour. Small: the lesser ones do,
    and the node itself. Edges run from the greater (a) to the lesser node (b)."""
    if large:
        least = _minimum_of_neighbours(edges)
        moved = edges.join(least, F.col("b") == F.col("node")).select("a", F.col("least").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        joined = edges.join(least, F.col("a") == F.col("node"))
        # (a, b) -> (b, least); and (a, least) once for each node.
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for all nodes of the edges (a, b) but roots.

    Each round is written to the shared folder, so it survives lost executors and its plan stays
    short. The rounds grow with the logarithm of the longest chain.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(ends.where("a <> b").distinct(), "edges")
    before = None
    while True:
        # Settled when a round changes nothing: every node then has one edge, to its root.
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not state[0] or tuple(state) == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)
        current = stored(_star(_star(current, large=True), large=False), "edges")
