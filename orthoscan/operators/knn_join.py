"""Nearest neighbours of many queries: points and queries meet cell by cell.

Points are dealt to units once and stored there as packed blocks: a unit is a
cell (``operators.cells``), or a part of one that holds more than UNIT_POINTS
points.  Each query first searches one unit of its own cell.  The distance of the
k-th point found there bounds the answer, so that then only units of cells whose
box is within that distance are searched.  What the units yield, at most k rows
a query each, is merged by query.

Neither queries nor points pass through the driver, and the points are read
once, whatever the number of queries.  The driver and every task hold a row a
cell, MOST_CELLS at most.  Queries that crowd into one unit are dealt to several
tasks, and the unit's block goes to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthoscan.operators.boxes import bounding_boxes
from orthoscan.operators.cells import Cuts, assign, sampled_splits
from orthoscan.operators.knn import nearest_rows
from orthoscan.sources.scratch import stored

#: Points of a unit, about; cells at most; queries that search a unit in one task, about.
UNIT_POINTS, MOST_CELLS, UNIT_QUERIES = 1 << 15, 1 << 12, 1 << 12
#: Axes that cells are cut along; and distances held at a time.
CELL_AXES, TILE = 8, 1 << 21
#: Distances by products of matrices are off by this part of the lengths' squares at most; they choose, exact ones decide.
SLACK = 1e-13

_FOUND = "qid long, record_id long, distance double"


@dataclass
class Zones:
    """The cells: their cuts, boxes (lo, hi: cells x dims) and numbers of units, in the order of ``cell``."""

    levels: list[Cuts]
    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    units: np.ndarray

    @property
    def first_unit(self) -> np.ndarray:
        return np.cumsum(self.units) - self.units


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 0)


def _zones(points: DataFrame, total: int, dims: int) -> Zones:
    depth = int(np.ceil(np.log2(min(MOST_CELLS, total / UNIT_POINTS))))
    levels = sampled_splits(points, depth, min(dims, CELL_AXES))
    rows = sorted(bounding_boxes(assign(points, levels), "cell", dims).collect())  # a row a cell
    units = np.array([-(-r.n // UNIT_POINTS) for r in rows])
    return Zones(levels, np.array([r.cell for r in rows]), np.array([r.lo for r in rows], dtype=np.float64), np.array([r.hi for r in rows], dtype=np.float64), units)


def _blocks(points: DataFrame, zones: Zones) -> DataFrame:
    """unit, ids, rows: the points of each unit as one block."""

    def pack(group: pa.Table) -> pa.Table:
        ids, x = group.column("record_id").to_numpy().astype(np.int64), _matrix(group.column("features").combine_chunks()).astype(np.float32)
        return pa.table({"unit": group.column("unit")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "rows": pa.array([x.tobytes()], pa.binary())})

    table = points.sparkSession.createDataFrame(pa.table({"cell": zones.cell, "first": zones.first_unit, "parts": zones.units}))
    dealt = assign(points, zones.levels).join(F.broadcast(table), "cell")  # a row a cell
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64("record_id"), F.col("parts"))).alias("unit"), "record_id", "features")
    return dealt.groupBy("unit").applyInArrow(pack, "unit long, ids binary, rows binary")


def nearest_in(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, distance) of the ``k`` rows of ``x`` nearest to each row of ``q``, by (distance, id)."""
    out = []
    sizes = (x * x).sum(axis=1)
    step = max(1, TILE // max(1, len(x)))
    for lo in range(0, len(q), step):
        own = q[lo : lo + step]
        weight = (own * own).sum(axis=1)
        near = sizes - 2 * (own @ x.T) + weight[:, None]
        slack = SLACK * x.shape[1] * (sizes.max(initial=0) + weight)
        most = k + 1 if exclude_self else k  # the query's own point may be among them
        limit = np.partition(near, most - 1, axis=1)[:, most - 1] if most < len(x) else np.full(len(own), np.inf)
        row, at = np.nonzero(near <= (limit + 2 * slack)[:, None])
        if exclude_self:
            other = ids[at] != qids[lo + row]
            row, at = row[other], at[other]
        gap = x[at] - own[row]
        d = np.sqrt(np.cumsum(gap * gap, axis=1)[:, -1])  # added up in the order of the axes
        order = np.lexsort((ids[at], d, row))
        row, at, d = row[order], at[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((row[rank < k] + lo, ids[at[rank < k]], d[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _search(blocks: DataFrame, visits: DataFrame, k: int, exclude_self: bool, crowded: bool) -> DataFrame:
    """qid, record_id, distance: the ``k`` nearest of a unit's points for each of its ``visits`` (unit, qid, features).

    ``blocks`` are packed, or rows (unit, record_id, features) of small units.
    """
    packed = "rows" in blocks.columns

    def search(key, points: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(points) or not len(queries):
            return pa.table({"qid": pa.array([], pa.int64()), "record_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if packed:
            ids = np.frombuffer(points.column("ids")[0].as_buffer(), dtype=np.int64)
            x = np.frombuffer(points.column("rows")[0].as_buffer(), dtype=np.float32).reshape(len(ids), -1).astype(np.float64)
        else:
            ids, x = points.column("record_id").to_numpy(), _matrix(points.column("features").combine_chunks())
        qids = queries.column("qid").to_numpy()
        at, found, d = nearest_in(x, ids, _matrix(queries.column("features").combine_chunks()), qids, k, exclude_self)
        return pa.table({"qid": pa.array(qids[at]), "record_id": pa.array(found), "distance": pa.array(d)})

    if crowded:
        tasks = stored(visits.groupBy("unit").agg(F.ceil(F.count("*") / UNIT_QUERIES).alias("tasks")), "knn-tasks")
        blocks = blocks.join(tasks, "unit").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
        visits = visits.join(tasks, "unit").withColumn("salt", F.pmod(F.xxhash64("qid", "features"), F.col("tasks")))
    else:
        blocks, visits = (df.withColumn("salt", F.lit(0).cast("long")) for df in (blocks, visits))
    sides = [df.select("unit", "salt", *more).groupBy("unit", "salt") for df, more in ((blocks, ["ids", "rows"] if packed else ["record_id", "features"]), (visits, ["qid", "features"]))]
    return sides[0].cogroup(sides[1]).applyInArrow(search, _FOUND)


def _visits(queries: DataFrame, zones: Zones) -> DataFrame:
    """unit, qid, features, of queries with their bound: all units that may hold a nearer point, but for the ``home`` one."""
    shared = queries.sparkSession.sparkContext.broadcast((zones.lo, zones.hi, zones.first_unit, zones.units))  # a row a cell

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, first, units = shared.value
        for batch in batches:
            q, home, bound = _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            step = max(1, TILE // max(1, lo.size))
            for a in range(0, len(q), step):
                own = q[a : a + step, None, :]
                gap = own - np.minimum(np.maximum(own, lo), hi)
                row, cell = np.nonzero(np.sqrt((gap * gap).sum(axis=2)) <= bound[a : a + step, None] * (1 + 1e-9) + 1e-300)
                row, unit = np.repeat(row, units[cell]), np.concatenate([np.arange(first[c], first[c] + units[c]) for c in cell]) if len(cell) else np.zeros(0, dtype=np.int64)
                away = unit != home[a + row]
                at = pa.array(a + row[away])
                yield pa.RecordBatch.from_arrays([pa.array(unit[away]), batch.column(0).take(at), batch.column(1).take(at)], ["unit", "qid", "features"])

    return queries.select("qid", "features", "home", "bound").mapInArrow(visit, "unit long, qid long, features array<float>")


def knn_join(points: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """The ``k`` nearest points (record_id, features) of every query (qid, features): qid, rank, record_id, distance.

    Qids are distinct, and all vectors have one length, that of the points; a
    query of another length is an error.  ``exclude_self`` leaves out the point whose
    record_id is the qid.  k <= 0, no points or no queries give no row.
    """
    spark = points.sparkSession
    points, queries = points.select("record_id", "features"), queries.select("qid", F.col("features").cast("array<float>").alias("features"))
    total, dims, asked = points.agg(F.count("*"), F.max(F.size("features"))).join(queries.agg(F.count("*"))).first()  # of one row each
    if k <= 0 or not total or not asked:
        return spark.createDataFrame([], "qid long, rank int, record_id long, distance double")
    if total <= UNIT_POINTS:
        one, home = (df.withColumn("unit", F.lit(0).cast("long")) for df in (points, queries))
        found = _search(one, home, k, exclude_self, asked > UNIT_QUERIES)
    else:
        zones = _zones(points, total, dims)
        blocks = stored(_blocks(points, zones), "knn-blocks")
        table = spark.createDataFrame(pa.table({"cell": zones.cell, "first": zones.first_unit, "parts": zones.units}))
        placed = assign(queries.withColumn("record_id", F.col("qid")), zones.levels).join(F.broadcast(table), "cell", "left")
        home = F.coalesce(F.col("first") + F.pmod(F.xxhash64("qid"), F.col("parts")), F.lit(-1).cast("long"))  # a cell without points has none
        placed = stored(placed.select("qid", "features", home.alias("unit")), "knn-queries")
        near = stored(_search(blocks, placed, k, exclude_self, True), "knn-home")
        bounds = near.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))
        bounded = placed.withColumnRenamed("unit", "home").join(bounds, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        more = stored(_visits(bounded, zones), "knn-visits")
        found = near.unionByName(_search(blocks, more, k, exclude_self, True))
    turn = Window.partitionBy("qid").orderBy("distance", "record_id")
    return found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("qid", "rank", "record_id", "distance")
