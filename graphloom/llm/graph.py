"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def _rooted(parent: DataFrame) -> DataFrame:
    """Follow (node, to) pointers, each to a smaller node or itself, to their ends by doubling."""
    while True:
        up = parent.select(F.col("node").alias("to"), F.col("to").alias("up"))
        after = table(parent.join(up, "to").select("node", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")))
        moved = after.filter("moved").limit(1).count()
        drop(parent)
        parent = after.select("node", "to")
        parent._graphloom_path = after._graphloom_path
        if not moved:
            return parent


def connect(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the (a, b) edges.

    Each round hangs every node on its smallest neighbour, follows the pointers and keeps the edges
    between different ends, so the edges shrink at least by half of their nodes a round.
    """
    left = table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    known: DataFrame | None = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min("b").alias("b"))
        root = _rooted(table(first.select(F.col("a").alias("node"), F.least("a", "b").alias("to"))))
        ends = root.select(F.col("node").alias("a"), F.col("to").alias("x"))
        others = root.select(F.col("node").alias("b"), F.col("to").alias("y"))
        after = left.join(ends, "a").join(others, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        after = table(after)
        if known is None:
            known = root
        else:
            moved = known.join(root.select(F.col("node").alias("to"), F.col("to").alias("up")), "to", "left")
            merged = table(moved.select("node", F.coalesce("up", "to").alias("to")))
            drop(known, root)
            known = merged
        drop(left)
        left = after
    if known is None:
        known = table(left.select(F.col("a").alias("node"), F.col("b").alias("to")))
    out = known.select("node", F.col("to").alias("component"))
    out._graphloom_path = known._graphloom_path
    return out
