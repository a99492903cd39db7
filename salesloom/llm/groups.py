"""Connected groups of links, in rounds of joins with every round written down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.session import stored


def connected(links: DataFrame, name: str = "groups") -> DataFrame:
    """Links (a, b) as (node, component): the smallest node that each node reaches.

    Rounds of large and small stars: every node hands its neighbours the smallest
    node it knows. The links of a round become fewer or point lower, until each
    node points at its component; rounds grow with the logarithm of a component's
    size. Nodes without a link to another are not in the result.
    """
    edges = stored(_downward(links.select("a", "b")).distinct(), name)
    before = _digest(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)), name)
        now = _digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _downward(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of them all."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    among = edges.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return least.select("a", F.col("least").alias("b")).unionByName(among).distinct()
