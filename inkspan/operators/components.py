"""Connected components of a table of links, as jobs over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.sources.staging import stage


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root): every node points at its least neighbour, if that is less than itself, and then at where that leads.

    Following pointers doubles their reach each time, so the rounds grow with the logarithm of the longest way down.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    parent = stage(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b")), "parents")
    while True:
        above = parent.select(F.col("a").alias("b"), F.col("b").alias("top"))
        reached = stage(parent.join(above, "b").select("a", "b", "top"), "parents")
        parent = reached.select("a", F.col("top").alias("b"))
        if reached.filter("b <> top").isEmpty():
            return parent.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(links: DataFrame) -> DataFrame:
    """(node, class) for every node of ``links`` (a, b): the least node it is linked with over any number of links.

    Each round melts the nodes that point at one root into it; at least half of the linked nodes go, so the rounds grow
    with the logarithm of the number of nodes. The returned table is staged.
    """
    edges = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    named = stage(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    named = named.select("node", F.col("node").alias("class"))
    while not edges.isEmpty():
        roots = _roots(edges)
        moved = roots.select(F.col("node").alias("class"), "root")
        named = stage(
            named.join(moved, "class", "left").select("node", F.coalesce("root", "class").alias("class")), "classes"
        )
        left = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        both = left.join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = stage(both.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    return named
