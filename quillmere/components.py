"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.sources.shared import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is its component's least node.

    Large-star and small-star steps in turn, each two shuffles of the edges; the number of turns
    grows with the logarithm of the longest path. Only minima are taken over a node's neighbours,
    so a hub is aggregated in parts before the shuffle; but its narrow edges meet in one task.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
        # small star: a node's lesser neighbours, and itself, all to the least of them
        lesser = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(lesser, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
        edges = cut_lineage(small)
        # nodes that have one root each, none of which has a root: stars, and nothing is left to do
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
