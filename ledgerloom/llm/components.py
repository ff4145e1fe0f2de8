"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Rows (node, root) for every linked node that is not itself the root, the smallest node of its component.

    Self links and NULL ends are ignored, repeated links count once; an empty table gives no rows. A round is three
    joins of the edges with one row per node, so a hub is one skewed key of a plain inner join and never a group in
    memory; rounds grow with the logarithm of the number of nodes. Every round is a table in the shared folder.
    """
    edges = links.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    )
    edges = cut(edges.distinct(), "edges")
    while not _are_stars(edges):
        edges = cut(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"))
    )
    each = ends.groupBy("node").agg(F.sum("down").alias("edges"), F.min("down").alias("least"))
    return each.where("edges > 1 or (edges = 1 and least = 0)").isEmpty()
