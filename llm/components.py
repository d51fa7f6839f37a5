"""Connected components of a graph of links, by alternating star contraction in Spark.

Each round lets every node point its larger (then its smaller) neighbours to the smallest node it knows,
until nothing changes: a number of rounds that grows with the logarithm of the longest chain. Rounds are
written to the shared folder, so lost executors cost one round. Links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round on `<a, b>` with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    moved = joined.filter(F.col("b") > F.col("a")) if large else joined.filter(F.col("b") != F.col("m"))
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`<node, root>` for every node of `<a, b>` links that is not the smallest of its component.

    Nodes are of any type with an order. Links may repeat, run either way or from a node to itself; null ends
    are left out. Nodes without links and smallest nodes do not appear.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") > F.col("b"))
    )
    edges = materialize(edges.distinct(), "links")
    seen = None
    while True:
        edges = materialize(_star(_star(edges, True), False), "links")
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
