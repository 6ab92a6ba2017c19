"""Bounding boxes: aggregation, range search, joins, and the choice of a node."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoscan.functions import vectors as V


def bounding_boxes(points: DataFrame, group: str | Sequence[str], dims: int, features: str = "features") -> DataFrame:
    """The group columns, n, lo, hi: the box of each group; combined in each task before the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    ends = [f(F.col(features)[i]).alias(f"_{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
    found = points.groupBy(*keys).agg(F.count("*").alias("n"), *ends)
    return found.select(*keys, "n", F.array(*[f"_lo{i}" for i in range(dims)]).alias("lo"), F.array(*[f"_hi{i}" for i in range(dims)]).alias("hi"))


def range_search(points: DataFrame, columns: Sequence[str], lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Rows whose ``columns`` lie in the closed box; plain comparisons, which reach the Parquet scan.

    An inverted box gives no row.
    """
    return points.where(reduce(and_, [F.col(c).between(a, b) for c, a, b in zip(columns, lo, hi, strict=True)]))


def range_search_points(points: DataFrame, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Like ``range_search`` for points in one array column ``features``."""
    return points.where(reduce(and_, [F.col("features")[i].between(a, b) for i, (a, b) in enumerate(zip(lo, hi, strict=True))]))


def choose_leaf(points: DataFrame, leaves: DataFrame) -> DataFrame:
    """record_id, node for every point: the leaf (node, lo, hi) that grows least, then the smaller, then the lower."""
    return with_leaf(points, leaves).select("record_id", "node")


def with_leaf(points: DataFrame, leaves: DataFrame) -> DataFrame:
    """``points`` with the ``node`` of ``choose_leaf``; rows that repeat an id keep a row each.

    ``leaves`` is the zone map of an index, a few thousand boxes; it goes to
    every task as the one value of a scalar subquery.
    """
    boxes = leaves.select(F.collect_list(F.struct("node", "lo", "hi", V.volume(F.col("lo"), F.col("hi")).alias("volume"))).alias("leaves"))
    p = F.col("features")
    rated = F.transform("leaves", lambda x: F.struct(V.enlargement(x["lo"], x["hi"], p, p).alias("growth"), x["volume"].alias("volume"), x["node"].alias("node")))
    return points.withColumn("leaves", boxes.scalar()).withColumn("node", F.array_min(rated)["node"]).drop("leaves")


def widest_variance_axis(points: DataFrame, group: str, dims: int) -> DataFrame:
    """group, axis: the axis with the largest population variance, the first on ties."""
    spread = F.array(*[F.var_pop(F.col("features")[i]) for i in range(dims)])
    return points.groupBy(group).agg(spread.alias("spread")).select(group, (F.array_position("spread", F.array_max("spread")) - 1).cast("int").alias("axis"))


def seed_pairs(boxes: DataFrame, group: str) -> DataFrame:
    """group, a, b: the two boxes (node, lo, hi) of each group with the most dead space; of a node's entries, so few."""
    pairs = boxes.alias("x").join(boxes.alias("y"), (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col("x.node") < F.col("y.node")))
    waste = V.dead_space(F.col("x.lo"), F.col("x.hi"), F.col("y.lo"), F.col("y.hi"))
    best = F.max_by(F.struct("x.node", F.col("y.node").alias("other")), F.struct(waste.alias("waste"), (-F.col("x.node")).alias("a"), (-F.col("y.node")).alias("b")))
    return pairs.groupBy(F.col(f"x.{group}").alias(group)).agg(best.alias("best"), F.max(waste).alias("waste")).select(group, F.col("best.node").alias("a"), F.col("best.other").alias("b"), "waste")


def box_distance(boxes: DataFrame, query: Sequence[float]) -> Column:
    return V.min_squared_distance(F.col("lo"), F.col("hi"), V.literal_point(query))


