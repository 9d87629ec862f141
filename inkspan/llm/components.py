"""Connected components of link tables by alternating star contraction, staged after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.frames import stage


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point the neighbours of each node at the least of them and the node.

    The least neighbour is an aggregate that combines before the shuffle; a node with very many
    neighbours is a skewed key of an ordinary join.
    """
    both = edges.select("a", "b") if not larger_only else edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger_only:
        pairs = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of ``links`` (a, b: long); nodes without links are absent.

    Each round is a large-star and a small-star step; the number of rounds grows with the logarithm of
    the longest path. It ends when every node is either a centre or points at one centre.
    """
    edges = stage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    while not _all_stars(edges):
        edges = stage(_to_least(_to_least(edges, True), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _all_stars(edges: DataFrame) -> bool:
    sides = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    counted = sides.groupBy("node").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    return counted.filter("below > 1 OR below > 0 AND above > 0").isEmpty()
