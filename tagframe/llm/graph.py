"""Connected components of a table of edges, by alternating large and small stars.

Every iteration rewires edges towards the smallest node seen and writes the edge
table to the shared folder, so no lineage grows and nothing is collected; only
counts and checksums reach the driver. The number of iterations grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagframe.llm import common


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Large: neighbours above a node link to its smallest neighbour; small: those below, and the node."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["u"])
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (x, y); the component is its smallest node. No edges, no rows."""
    e = edges.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    e = common.stage(e, "edges")
    before = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or now == before:
            break
        before = now
        e = common.stage(star(common.stage(star(e, True), "large-star"), False), "small-star")
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(e.select(F.col("b"), F.col("b")).distinct())
