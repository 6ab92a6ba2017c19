"""The feature pipeline: choose columns, fill in, augment, standardise, project."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoscan.functions import vectors as V

#: Added to every standard deviation.
EPSILON = 1e-9
NOISE = 0.01
DIMS = (2, 5, 10, 20, 30)


def unit_weights(n: int, seed: int = 42) -> list[float]:
    """A random direction of length one."""
    w = np.random.Generator(np.random.PCG64(seed)).normal(size=n)
    return (w / np.linalg.norm(w)).tolist()


def select_features(df: DataFrame, names: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``features``: the named columns that exist, in the listed order, then a random projection of them for each that is missing."""
    present = [n for n in names if n in df.columns]
    base = F.array(*[F.col(n).cast("float") for n in present])
    filled = [V.dot(base, unit_weights(len(present), seed + i)).cast("float") for i in range(len(names) - len(present))]
    return df.withColumn("features", F.concat(base, F.array(*filled)) if filled else base)


def class_counts(df: DataFrame, key: str) -> DataFrame:
    """The distinct classes and how many rows each has."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def random_projection(points: DataFrame, weights: Sequence[float], to: str = "projected") -> DataFrame:
    return points.withColumn(to, V.dot(F.col("features"), weights))


def _stats(points: DataFrame, dims: int) -> list[Column]:
    return [f(F.col("features")[i].cast("double")).alias(f"{n}_{i}") for i in range(dims) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]


def feature_stats(points: DataFrame, dims: int) -> DataFrame:
    """axis, mean, std (of the population, plus EPSILON), in one pass."""
    row = points.agg(*_stats(points, dims))
    pairs = F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"mean_{i}").alias("mean"), (F.col(f"std_{i}") + EPSILON).alias("std")) for i in range(dims)])
    return row.select(F.inline(pairs))


def stats_arrays(points: DataFrame, dims: int) -> tuple[list[float], list[float]]:
    row = points.agg(*_stats(points, dims)).first()
    return [row[f"mean_{i}"] for i in range(dims)], [row[f"std_{i}"] + EPSILON for i in range(dims)]


def standardise(points: DataFrame, mean: Sequence[float], std: Sequence[float], to: str = "features") -> DataFrame:
    scaled = F.array(*[(F.col("features")[i].cast("double") - float(m)) / float(s) for i, (m, s) in enumerate(zip(mean, std, strict=True))])
    return points.withColumn(to, scaled)


def augment(points: DataFrame, target: int, dims: int, noise: float = NOISE, seed: int = 42) -> DataFrame:
    """Exactly ``target`` rows from dense record_ids: copy 0 unchanged, later copies with noise.

    record_id mod n is the id of the original, where n is the number of rows.
    The noise is a multiple of each axis's standard deviation.
    """
    n = points.count()
    if not n:
        return points
    _, std = stats_arrays(points, dims)
    copies = points.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-target // n) - 1)))))
    rows = copies.withColumn("record_id", F.col("_copy") * n + F.col("record_id")).where(F.col("record_id") < target)
    moved = F.array(*[(F.col("features")[i] + F.when(F.col("_copy") > 0, F.randn(seed + i) * s * noise).otherwise(0.0)).cast("float") for i, s in enumerate(std)])
    return rows.withColumn("features", moved if noise else F.col("features")).drop("_copy")


@dataclass(frozen=True)
class Projection:
    """mean, std and components (one row per output dimension) of a fitted pipeline."""

    mean: list[float]
    std: list[float]
    components: list[list[float]]

    def apply(self, points: DataFrame, dims: int | None = None) -> DataFrame:
        """``features`` standardised and projected, cut to ``dims``."""
        scaled = standardise(points, self.mean, self.std, "_scaled")
        out = [V.dot(F.col("_scaled"), row).cast("float") for row in self.components[:dims]]
        return scaled.withColumn("features", F.array(*out)).drop("_scaled")


def fit_projection(points: DataFrame, dims: int, components: int) -> Projection:
    """Standardise and fit principal components; each has its largest loading positive."""
    mean, std = stats_arrays(points, dims)
    scaled = standardise(points, mean, std).select(array_to_vector("features").alias("v"))
    found = PCA(k=components, inputCol="v", outputCol="p").fit(scaled).pc.toArray().T
    signs = np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])
    return Projection(mean, std, (found * signs[:, None]).tolist())


def fixed_projection(dims: int, components: int) -> list[list[float]]:
    """A cosine basis: orthonormal rows that need no fit, for tests and comparisons."""
    i = np.arange(dims)
    rows = [np.cos(np.pi * (i + 0.5) * c / dims) for c in range(1, components + 1)]
    return [(r / np.linalg.norm(r)).tolist() for r in rows]
