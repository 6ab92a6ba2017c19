"""Tables of vectors: validation, append, lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.functions.vectors import is_valid
from orthoscan.operators.ranks import dense_ids


def reject_invalid(points: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): vectors of another length, or with null, NaN or infinite elements, are rejected."""
    ok = F.coalesce(is_valid(F.col("features"), dims), F.lit(False))
    return points.where(ok), points.where(~ok)


def append(spark: SparkSession, path: str, vectors: DataFrame, order: list[str]) -> None:
    """Append rows with ids that go on after the largest stored one, in the given order; for one writer at a time (see ``sources.snapshots``)."""
    try:
        first = spark.read.parquet(path).agg(F.max("record_id")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        first = None
    new = dense_ids(vectors, order).withColumn("record_id", F.col("record_id") + (0 if first is None else first + 1))
    new.select("record_id", "features").write.mode("append").parquet(path)


def lookup(points: DataFrame, record_id: int) -> DataFrame:
    """The row with this id, or none; the comparison reaches the scan."""
    return points.where(F.col("record_id") == record_id)


def lookup_many(points: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """The rows with these ids; Spark chooses the join by the size of ``ids``."""
    if isinstance(ids, DataFrame):
        return points.join(ids.select("record_id").distinct(), "record_id", "left_semi")
    return points.where(F.col("record_id").isin([int(i) for i in ids]))
