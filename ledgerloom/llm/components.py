"""Connected components of a table of links, by alternating large and small stars.

Nothing is collected: each round is two grouped minima and two joins, written to the shared
folder, and rounds end when all edges point at the smallest node of their component. Minima
are written before they are joined back, so that Spark can split the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import removed, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node with a link to another; component is the smallest node.

    Links may be repeated, in either direction or from a node to itself; null ends are left out.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v")
    edges = written(ends.distinct(), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        for done in (edges, least, large, down):
            removed(done)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down and no centre has any."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()
