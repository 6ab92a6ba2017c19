"""The test tables as points, boxes and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """record_id, features, label; ``dims`` cuts the vectors."""
    features = F.col("embedding") if dims is None else F.slice("embedding", 1, dims)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), features.alias("features"), "label")


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by price and day."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.array(F.col("o_totalprice").cast("float"), days.cast("float")).alias("features"))


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size and price, with the brand; sizes tie often."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.array(F.col("p_size").cast("float"), F.col("p_retailprice").cast("float")).alias("features"), "p_brand", "p_type")
