"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoscan.llm.common import stored


def _star(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with m, the least of u and its neighbours.

    The minima are written first: the join then shuffles both sides itself, so
    that Spark can split the partition of a node with very many neighbours.
    """
    return pairs.join(stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-min"), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) from edges (a, b) of longs.

    Loops and repeated edges are ignored, and so are edges with a null end;
    nodes without any other edge don't appear.  No edges, no rows.  Rounds end
    when a round leaves the edges as they are; they are then stars.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    pairs = stored(pairs, "star")
    before = mark(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star-large")
        small = _star(large)
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        pairs = stored(small.distinct(), "star")
        after = mark(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
