"""Exact search that reads only the cells that can hold an answer.

An index is two tables: the points, partitioned by runs of cells and sorted by
cell, and their zone map.  A search first asks the zone map, which has a row per
cell; the cells that can matter are semi-joined with the points, and Spark's
dynamic partition pruning keeps the scan to their runs.  Of the zone map, k rows
at most reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.functions import vectors as V
from orthoscan.operators import boxes, cells, knn
from orthoscan.sources.scratch import scratch_path

#: Beyond this share of the cells a full scan takes their place.
MOST_CELLS = 0.5
#: Tables of fewer points are scanned, which is cheaper than asking twice.
SMALL_TABLE = 1_000_000
#: Folders that the points of an index lie in at most; and cells up to which their names are sent to every task.
MOST_PARTS, MOST_NAMED = 256, 1 << 16


@dataclass
class CellIndex:
    """Points by ``part``, a run of cells, and their zone map, on disk; ``delta`` holds points appended since."""

    spark: SparkSession
    path: str
    dims: int
    delta: str | None = None

    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/points")

    def zones(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/zones")

    def unindexed(self) -> DataFrame | None:
        return self.spark.read.parquet(self.delta) if self.delta else None

    def everything(self) -> DataFrame:
        """All points (record_id, features), appended ones included."""
        rows = self.points().select("record_id", "features")
        return rows.unionByName(self.unindexed().select("record_id", "features")) if self.delta else rows


def write_index(celled: DataFrame, dims: int, path: str | None = None) -> CellIndex:
    """Write points that have a ``cell`` (see ``operators.cells``) and their zone map."""
    spark = celled.sparkSession
    path = path or scratch_path(spark, "cell-index")
    last = celled.agg(F.max("cell")).first()[0] or 0
    parted = celled.select("record_id", "features", "cell", F.shiftright("cell", max(0, last.bit_length() - (MOST_PARTS - 1).bit_length())).cast("int").alias("part"))
    parted.repartitionByRange("cell", "record_id").sortWithinPartitions("part", "cell").write.partitionBy("part").parquet(f"{path}/points")
    cells.zone_map(spark.read.schema(parted.schema).parquet(f"{path}/points"), dims, "part").write.parquet(f"{path}/zones")
    spark.range(1).select(F.lit(dims).alias("dims")).write.parquet(f"{path}/about")
    return CellIndex(spark, path, dims)


def open_index(spark: SparkSession, path: str, delta: str | None = None) -> CellIndex | None:
    """The index that was written to ``path``, or None if there is none (or none that was finished)."""
    try:
        return CellIndex(spark, path, spark.read.parquet(f"{path}/about").first()["dims"], delta)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def search(index: CellIndex | None, points: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k nearest points by the index, or by a scan of ``points`` where none was built."""
    return knn.knn(points, query, k) if index is None else pruned_knn(index, query, k)[0]


def append(index: CellIndex, points: DataFrame) -> CellIndex:
    """Add points that searches see at once; they join the cells at the next build."""
    delta = index.delta or scratch_path(index.spark, "cell-delta")
    points.select("record_id", "features").write.mode("append").parquet(delta)
    return CellIndex(index.spark, index.path, index.dims, delta)


def pruned_knn(index: CellIndex, query: Sequence[float], k: int, method: str = "cells") -> tuple[DataFrame, dict[str, int]]:
    """The k nearest points, as ``knn`` gives them, and how many cells there are and were read.

    The nearest cells that hold k points give an upper bound of the k-th
    distance; then only cells whose box is at most so far are read, ties
    included.  ``method="auto"`` scans small tables instead.
    """
    if len(query) != index.dims:
        raise ValueError(f"the query has {len(query)} dimensions, the points have {index.dims}")
    zones = index.zones().select("part", "cell", "n", boxes.box_distance(index.zones(), query).alias("d"))
    scan = k <= 0 or method == "linear" or (method == "auto" and (zones.agg(F.sum("n")).first()[0] or 0) < SMALL_TABLE)
    bound = None if scan else _kth_bound(index, zones, query, k)
    inside = zones.where(F.lit(False) if bound is None else F.col("d") <= bound)
    about = zones.agg(F.count("*").alias("cells"), F.count(F.when(F.lit(False) if bound is None else F.col("d") <= bound, 1)).alias("inside")).first()
    if bound is None or about["inside"] > MOST_CELLS * about["cells"]:
        return knn.knn(index.everything(), query, k), {"cells_total": about["cells"], "cells_scanned": about["cells"]}
    named = F.broadcast(inside) if about["inside"] <= MOST_NAMED else inside
    return knn.knn(_of_cells(index, named), query, k), {"cells_total": about["cells"], "cells_scanned": about["inside"]}


def _kth_bound(index: CellIndex, zones: DataFrame, query: Sequence[float], k: int) -> float | None:
    """A squared distance that the k-th nearest point doesn't exceed, or None where the cells hold fewer points.

    Every cell holds a point, so the nearest k cells hold k of them.
    """
    first, parts, held = [], set(), 0
    for r in zones.orderBy("d", "cell").limit(k).collect():
        first.append(r["cell"])
        parts.add(r["part"])
        held += r["n"]
        if held >= k:
            break
    if held < k:
        return None
    near = index.points().where(F.col("part").isin(sorted(parts)) & F.col("cell").isin(first)).select(V.squared_distance(F.col("features"), query).alias("d"), "record_id")
    return near.orderBy("d", "record_id").limit(k).agg(F.max("d")).first()[0] * (1 + 1e-9) + 1e-300


def _of_cells(index: CellIndex, wanted: DataFrame) -> DataFrame:
    """The points (record_id, features) of the ``wanted`` rows of the zone map, and all appended ones."""
    rows = index.points().join(wanted.select("part", "cell"), ["part", "cell"], "left_semi").select("record_id", "features")
    return rows.unionByName(index.unindexed().select("record_id", "features")) if index.delta else rows


def pruned_range(index: CellIndex, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Points (record_id, features) in the closed box, from the cells whose boxes overlap it."""
    a, b = V.literal_point(lo), V.literal_point(hi)
    return boxes.range_search_points(_of_cells(index, index.zones().where(V.overlaps(F.col("lo"), F.col("hi"), a, b))), lo, hi)


def by_dims(points: DataFrame, query: Sequence[float], k: int, dims: Sequence[int]) -> DataFrame:
    """dims, rank, record_id, distance: the same search over prefixes of the vectors, in one scan."""
    return knn.knn_prefixes(points, query, k, dims)


def by_methods(points: DataFrame, indexes: dict[str, dict[int, CellIndex]], query: Sequence[float], k: int, dims: Sequence[int]) -> DataFrame:
    """method, dims, rank, record_id, distance: the search over every prefix by a scan and by every index.

    ``indexes`` names the methods and gives an index for some of the ``dims``;
    where a method has none, its rows come from a scan.
    """
    out = by_dims(points, query, k, dims).select(F.lit("linear").alias("method"), "*")
    for method, built in indexes.items():
        for d in dims:
            prefix = points.select("record_id", V.truncate(F.col("features"), d).alias("features"))
            found = search(built.get(d), prefix, list(query)[:d], k)
            out = out.unionByName(found.select(F.lit(method).alias("method"), F.lit(d).alias("dims"), "rank", "record_id", "distance"))
    return out


def media_search(points: DataFrame, indexes: dict[str, dict[int, CellIndex]], query: Sequence[float], k: int, dims: Sequence[int], enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """method, dims, error, neighbors: one row per method and number of dimensions.

    ``enrich`` adds metadata to the results (``operators.enrich``).  A query
    shorter than ``dims`` has an error instead of neighbours.
    """
    able = [d for d in dims if d <= len(query)]
    spark = points.sparkSession
    failed = spark.createDataFrame([(m, d, f"the query has {len(query)} dimensions") for m in ("linear", *indexes) for d in dims if d > len(query)], "method string, dims int, error string")
    found = enrich(by_methods(points, indexes, query, k, able)) if able else None
    if found is None:
        return failed.withColumn("neighbors", F.expr("cast(array() as array<struct<rank:int>>)"))
    columns = ["rank", *[c for c in found.columns if c not in ("method", "dims", "rank")]]
    rows = found.groupBy("method", "dims").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("neighbors"))  # k each
    return rows.unionByName(failed, allowMissingColumns=True).select("method", "dims", "error", F.coalesce("neighbors", F.array().cast(rows.schema["neighbors"].dataType)).alias("neighbors"))
