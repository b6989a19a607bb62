"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import spread_join
from .storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return spread_join(both.where(F.col("b") > F.col("a")), least, "a", "b").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = spread_join(edges, least, "a", "b").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root: one edge for each node, and no root hangs itself."""
    rows, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
    return rows == nodes and edges.select("b").distinct().join(edges.select(F.col("a").alias("hung")), F.col("b") == F.col("hung"), "left_semi").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is its smallest node.

    Links may repeat, run in either direction or join a node to itself; null ends are ignored.  No
    link reaches the driver: each round writes its edges, and two counts tell whether all
    components are stars.  The number of rounds grows with the logarithm of the longest chain; a
    round that changes nothing settles, so that they end.  A node with any number of links is spread
    over many tasks.
    """
    plain = links.where("a is not null and b is not null and a != b")
    edges = stored(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(edges):
        edges = stored(_small_star(_large_star(edges)).distinct(), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
