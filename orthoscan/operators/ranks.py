"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoscan.sources.scratch import stored


def global_rank(df: DataFrame, order: list[str], to: str = "rank") -> DataFrame:
    """Add the row's number from 0 in the order of the columns ``order``, which should be a total one.

    The rows are range-partitioned, sorted and numbered as they are written, in
    one shuffle; the counts of the partitions before, one row each, are added.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_nth", F.monotonically_increasing_id())
    within = stored(ranged.withColumns({"_part": F.shiftright("_nth", 33).cast("int"), "_nth": F.col("_nth").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))}), "ranked")
    parts = within.groupBy("_part").count()
    before = parts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return within.join(F.broadcast(before), "_part").withColumn(to, (F.col("_before") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_before")


def rank_within(df: DataFrame, group: str, order: list[str], to: str = "rank") -> DataFrame:
    """Like ``global_rank``, but counting anew in each group; groups are few (cells, slabs)."""
    ranked = global_rank(df, [group, *order], "_global")  # its rows are stored
    first = ranked.groupBy(group).agg(F.min("_global").alias("_first"))
    return ranked.join(F.broadcast(first), group).withColumn(to, F.col("_global") - F.col("_first")).drop("_global", "_first")


def dense_ids(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Add ``record_id``: dense ids from 0 in the given order."""
    return global_rank(df, order, "record_id")


def top_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps only ``n`` a group and task before the shuffle."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_turn", turn).where(F.col("_turn") <= n).drop("_turn")
