"""Connected components of a graph of row ids, in rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Alternates the large-star and small-star steps: each node's neighbours are re-attached to the smallest of them, until
    nothing changes. Each round is a partial aggregation by node and a join whose large keys can be split, and is
    checkpointed; only counts come to the driver. Loops and repeated edges do no harm; without edges there are no rows.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def attach(pairs: DataFrame) -> DataFrame:
        """pairs with m, the smallest of u and its neighbours."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = mark(edges)
    while before[0]:
        large = attach(both(edges)).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = attach(large.select(F.col("a").alias("u"), F.col("b").alias("v")))  # a > b: all neighbours are smaller
        small = down.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = small.select("e.a", "e.b").where("a <> b").distinct().checkpoint()
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
