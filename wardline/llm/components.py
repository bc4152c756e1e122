"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import Shelf

#: No corpus needs as many: rounds grow with the logarithm of the longest path.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("root"))
    return both.filter("other > node").join(least, "node").select(
        F.col("other").alias("high"), F.col("root").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("root"))
    moved = edges.join(least, "high").filter("low > root").select(F.col("low").alias("high"), F.col("root").alias("low"))
    return moved.union(least.select("high", F.col("root").alias("low")))


def components(shelf: Shelf, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component; roots themselves are left out.

    Every round is written to the shared folder, so no plan grows and lost executors cost
    one round at most. Nothing but a count and a checksum comes to the driver.
    """
    edges = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    seen = None
    for turn in range(MOST_ROUNDS):
        edges = shelf.keep(edges, f"edges-{turn}")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
        seen = state
        edges = _small_star(_large_star(edges).distinct()).distinct()
    raise RuntimeError("the components did not settle")
