"""Connected components of an edge table by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large-star hangs every larger neighbour of a node on the node's smallest
    neighbour (itself included); small-star does so with the smaller neighbours and the
    node itself. A node's neighbours are never gathered: only their minimum is."""
    if large:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = both.join(least, "a")
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = (hung.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
               .union(least.select("a", F.col("m").alias("b"))))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of one orderable type -> (node, component), the component named by
    its smallest node; nodes without an edge are not listed. Ends when a round leaves the
    edge table as it was; rounds grow with the logarithm of the longest path."""
    now = materialize(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    mark = None
    while True:
        now = materialize(_star(_star(now, large=True), large=False))
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b"), F.col("b")).distinct())
        mark = new
