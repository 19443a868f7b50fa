"""Connected components by alternating star contraction, in DataFrame operations.

Nothing is collected: every round rewrites the edge table in the shared folder.
Group minima are partial aggregates, written before they are joined: adaptive execution
splits a join of two plain exchanges where one node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch

MAX_ROUNDS = 60


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
    return both.join(least, "a").filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges run from larger to smaller."""
    least = scratch.put(edges.groupBy("a").agg(F.min("b").alias("m")), name)
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b), component the smallest node of its class.

    Nodes are not null. Loops and repeated edges do not matter; no edges, no rows.
    """
    ordered = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = scratch.put(ordered, f"{name}-0"), None
    for k in range(1, MAX_ROUNDS):
        wide = scratch.put(_large_star(current, scratch, f"{name}-wide-least"), f"{name}-wide")
        moved = scratch.put(_small_star(wide, scratch, f"{name}-least"), f"{name}-{k}")
        state = moved.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        current = moved
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
