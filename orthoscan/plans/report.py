"""Reports that compare methods: timings, speedups, the fastest, engine status."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.functions.names import speedup, winner
from orthoscan.operators import knn
from orthoscan.plans.pruned import CellIndex, pruned_knn


def timed(action: Callable[[], object]) -> tuple[object, int]:
    """What the action returns, and the microseconds it took."""
    began = time.perf_counter_ns()
    out = action()
    return out, (time.perf_counter_ns() - began) // 1000


def compare(kd: DataFrame, rt: DataFrame, linear: DataFrame) -> DataFrame:
    """Join timings by dims and derive speedups and the winner.

    ``kd`` and ``rt`` have dims, time_us, error; ``linear`` has dims, time_us.
    A method that failed for some dims leaves nulls there and its error; the
    others stay.
    """
    named = lambda df, n: df.select("dims", F.col("time_us").alias(f"{n}_time_us"), *([F.col("error").alias(f"{n}_error")] if "error" in df.columns else []))
    all_dims = named(kd, "kd").join(named(rt, "rt"), "dims", "full_outer").join(named(linear, "linear"), "dims", "full_outer")
    return all_dims.select(
        "dims", "kd_time_us", "rt_time_us", "linear_time_us",
        speedup(F.col("linear_time_us"), F.col("kd_time_us")).alias("kd_speedup"), speedup(F.col("linear_time_us"), F.col("rt_time_us")).alias("rt_speedup"),
        winner(F.col("kd_time_us"), F.col("rt_time_us"), F.col("linear_time_us")).alias("winner"), F.coalesce("kd_error", "rt_error").alias("error"),
    )


def search_report(indexes: dict[int, tuple[CellIndex | None, CellIndex | None]], query: Sequence[float], k: int) -> DataFrame:
    """Time both indexes and the scan for each number of dimensions; one row each (see ``compare``).

    A missing index, or one that fails, gives an error in its row and doesn't
    stop the others.
    """
    kd, rt, linear = [], [], []
    spark = None
    for dims, both in indexes.items():
        for rows, index in zip((kd, rt), both, strict=True):
            if index is None:
                rows.append((dims, None, "index_not_built"))
                continue
            spark = index.spark
            try:
                _, us = timed(lambda i=index, d=dims: pruned_knn(i, list(query)[:d], k)[0].collect())
                rows.append((dims, us, None))
            except Exception as e:  # reported by dimension, as the result's own column
                rows.append((dims, None, str(e)[:200]))
        for index in both:
            if index is not None:
                linear.append((dims, timed(lambda i=index, d=dims: knn.knn(i.everything(), list(query)[:d], k).collect())[1]))
                break
    spark = spark or SparkSession.getActiveSession()
    tables = [spark.createDataFrame(rows, "dims int, time_us long, error string") for rows in (kd, rt)]
    return compare(*tables, spark.createDataFrame(linear, "dims int, time_us long"))


def valid_results(results: DataFrame) -> DataFrame:
    """Results without error that have neighbours."""
    return results.where((F.size("neighbors") > 0) & F.col("error").isNull())


def status(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """name, records of every table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("records")).select(F.lit(name).alias("name"), "records")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "name string, records long")
