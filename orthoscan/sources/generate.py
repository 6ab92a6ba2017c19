"""Seeded point sets for demonstrations; every row follows from its id and the seed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, salt: int):
    """A number in [0, 1) from the row's id, the same however the rows are split."""
    return (F.xxhash64("record_id", F.lit(seed), F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1).cast("long")) / float(1 << 52)).cast("double")


def _normal(seed: int, salt: int):
    u, v = F.greatest(_uniform(seed, 2 * salt), F.lit(1e-300)), _uniform(seed, 2 * salt + 1)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)


def uniform_points(spark: SparkSession, n: int, dims: int = 2, high: float = 1000.0, seed: int = 42) -> DataFrame:
    """record_id, features uniform in [0, high)."""
    return spark.range(n).withColumnRenamed("id", "record_id").withColumn("features", F.array(*[(_uniform(seed, i) * high).cast("float") for i in range(dims)]))


def clustered_points(spark: SparkSession, n: int, dims: int, centres: int, spread: float, noise: float, seed: int) -> DataFrame:
    """record_id, class, features: normal noise around normal centres; the class is the id modulo ``centres``."""
    middle = np.random.Generator(np.random.PCG64(seed)).normal(0, spread, (centres, dims))
    at = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in middle])
    rows = spark.range(n).withColumnRenamed("id", "record_id").withColumn("class", (F.col("record_id") % centres).cast("int"))
    return rows.withColumn("features", F.array(*[(F.get(F.get(at, F.col("class")), F.lit(i)) + _normal(seed, i) * noise).cast("float") for i in range(dims)]))


def audio_names(points: DataFrame, genres: Sequence[str]) -> DataFrame:
    """pos, record_id, filename, genre: a row a point; the genre is the one of its class, the number counts on."""
    genre = F.get(F.array(*[F.lit(g) for g in genres]), F.pmod("class", F.lit(len(genres))))
    return points.select(F.col("record_id").alias("pos"), "record_id", F.format_string("%s.%05d.wav", genre, F.col("record_id")).alias("filename"), genre.alias("genre"))


def image_paths(points: DataFrame, labels: Sequence[str]) -> DataFrame:
    """pos, record_id, filepath, label: a row a point, in a folder of its class's label."""
    label = F.get(F.array(*[F.lit(x) for x in labels]), F.pmod("class", F.lit(len(labels))))
    return points.select(F.col("record_id").alias("pos"), "record_id", F.format_string("%s/%s_%d.jpg", label, label, F.col("record_id")).alias("filepath"), label.alias("label"))


def sample_audio(spark: SparkSession, n: int = 1000) -> DataFrame:
    return clustered_points(spark, n, 30, 10, 2.0, 0.5, 42)


def sample_images(spark: SparkSession, n: int = 1000) -> DataFrame:
    return clustered_points(spark, n, 30, 15, 2.5, 0.4, 99)
