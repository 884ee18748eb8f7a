"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm import common


def min_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component.

    ``edges`` has bigint columns a and b. Large-star and small-star steps
    alternate until the edges are stars around their smallest node, which takes
    a number of rounds logarithmic in the size of a component. Each round is
    two aggregations by node; none of them gathers a component in one place.
    """
    pairs = common.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node moves to the smallest of its neighbourhood
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # small star: the smaller neighbours of a node, and the node, move to the smallest of them
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        pairs = common.cut(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    centres = pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres)
