"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b): hooks neighbours on the least neighbour of each node.

    The least neighbour comes from an aggregate that combines before the shuffle and is joined back, so a node with
    very many neighbours is neither gathered nor windowed in one task (skewed joins are split at run time).
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        hooked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hooked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hooked.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long) that is not the least of its component, whose root it gets.

    Every round is written to the shared folder, so lost executors cost one round at most. Rounds end when the edges
    no longer change; their number grows with the logarithm of the longest path.
    """
    edges, before = stored(edges.where("a <> b").distinct(), "edges"), None
    for _ in range(rounds):
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges, before = stored(_stars(_stars(edges, large=True), large=False), "edges"), state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
