"""Connected components of a graph of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.llm.rows import stored


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of every node on the ``a`` side, written: a join with a written table has
    nothing between it and its shuffles, so AQE can split a node with very many links."""
    return stored(edges.groupBy("a").agg(F.min("b").alias("low")), "least-neighbours")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the node's smallest neighbour (itself included)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.filter("b > a").join(_least(both), "a").withColumn("low", F.least("low", "a"))
    return linked.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    linked = down.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.union(least.select("a", F.col("low").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node in the links ``a``, ``b``; root is the smallest node reachable.

    The number of rounds is logarithmic in the longest path. Each round is written to the shared
    folder. Nodes with very many links are aggregated before the shuffle and joined as one side with a
    unique key, which AQE splits. Links of a node with itself and repeated links change nothing.
    """
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = stored(down.distinct(), "links"), None
    while not edges.isEmpty():
        edges = stored(_large_star(edges).distinct(), "large-star")
        edges = stored(_small_star(edges).distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
