"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum and one equi-join on the node, so nothing but row counts reaches the driver, and the
lineage is cut by a written table after every step. A node with very many links is combined before the shuffle
(minimum), and the minima are written, so that the join is one of two plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import carries, discard, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours go to the smallest of the node and its neighbours. Small star: its smaller
    neighbours and itself do. The result is written."""
    if large:
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    least = written(least.select(F.col("a").alias("node"), "m"), "least")
    joined = near.join(least, near["a"] == least["node"])
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
    out = written(moved.where("a <> b").distinct(), "links")
    discard(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b; both directions and repeats allowed); component is
    the smallest node reachable. An empty table gives an empty result; loops (a = b) are ignored."""
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # stable when every node has one smaller neighbour and no node is both a child and a parent
        half = _star(links, True)
        after = _star(half, False)
        discard(half)
        stable = after.count() == links.count() and after.exceptAll(links).isEmpty()
        discard(links)
        if stable:
            break
        links = after
    roots = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return carries(after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), after)
