"""Partitions of points for pruning: median-split cells and packed leaves.

Both give every point a ``cell`` and summarise cells in a zone map
(cell, n, lo, hi) whose size is the number of cells, not of points.

Exact cells are cut at points of a given rank, which histograms find: each round
reads the points once and sends counts of bins, then only the bins that hold a
cut are looked into.  No point is sorted, and none is moved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoscan.operators.boxes import bounding_boxes
from orthoscan.sources.scratch import stored

#: Bins of a histogram, a cell and round; and cuts of a cell that a point is compared with one by one.
BINS, FEW_CUTS = 1 << 14, 64
#: Bins, rows and cuts that the driver may hold.
HISTOGRAM, FEW_ROWS, DRIVER_CUTS = 1 << 20, 1 << 16, 1 << 16
#: Cuts up to which a table of them is written into the plan.
SHORT = 256


def _bin(bins: int = BINS) -> Column:
    """The bin, of ``bins``, of a row's ``_key`` within v_lo to v_hi or, where all keys are one, of its id within id_lo to id_hi.

    It is never less for a greater row, and not the same for the least and the greatest.
    """
    part = lambda x, lo, hi: F.least(F.lit(bins - 1), F.floor((x - lo) / (hi - lo) * bins)).cast("int")
    x, lo, hi = (F.col(c).cast("double") for c in ("record_id", "id_lo", "id_hi"))
    by_id = F.when(lo < hi, part(x, lo, hi)).otherwise(F.when(F.col("record_id") > F.col("id_lo"), 1).otherwise(0))  # ids too close for doubles
    return F.when(F.col("v_lo") < F.col("v_hi"), part(F.col("_key"), F.col("v_lo"), F.col("v_hi"))).otherwise(by_id)


def _cuts_inside(slabs: int, up: bool) -> tuple[Column, Column]:
    """First and last number of the cuts whose rank is from ``base`` to ``base`` + ``n`` - 1 in a cell of ``total`` rows.

    Cut j, from 1 to ``slabs`` - 1, has the rank j * total / slabs, rounded up or down.
    """
    lo = f"(base - 1) * {slabs} div total + 1" if up else f"(base * {slabs} + total - 1) div total"
    hi = f"(base + n - 1) * {slabs} div total" if up else f"((base + n) * {slabs} + total - 1) div total - 1"
    return F.expr(f"greatest({lo}, 1L)"), F.expr(f"least({hi}, {slabs - 1}L)")


_SPAN = ["v_lo", "v_hi", "id_lo", "id_hi"]


def _spans() -> list[Column]:
    return [F.count("*").alias("n"), F.min("_key").alias("v_lo"), F.max("_key").alias("v_hi"), F.min("record_id").alias("id_lo"), F.max("record_id").alias("id_hi")]


def rank_cuts(points: DataFrame, slabs: int, up: bool) -> tuple[DataFrame, DataFrame]:
    """(cell, cut, v, id: the row of ``points`` (cell, _key, record_id) at each of the ranks that cut its cell into ``slabs``;
    cell, bin, base, total and the cell's span: the first round's histogram).

    Rows are ordered by ``_key`` (double), then record_id; see ``_cuts_inside``
    for the ranks.  Each round splits what is left of a cell into BINS by value,
    or by id where one value is left, between the least and the greatest that
    are really there; so a round narrows every cut, until it names one row.
    """
    first, last = _cuts_inside(slabs, up)
    whole = points.groupBy("cell").agg(*_spans())
    state = stored(whole.select("cell", F.lit("").alias("path"), F.lit(0).cast("long").alias("base"), F.col("n").alias("total"), *_SPAN), "cell-spans")
    rows, histogram, found = points.withColumn("path", F.lit("")), None, None
    while True:
        rows = rows.join(state, ["cell", "path"]).withColumn("bin", _bin())
        counted = rows.groupBy("cell", "path", "bin").agg(*_spans(), F.first("base").alias("base"), F.first("total").alias("total"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("cell", "path").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = stored(counted.withColumn("base", F.col("base") + before), "cell-bins")
        if histogram is None:
            histogram = bins.select("cell", "bin", "base", "n", "total").join(state.select("cell", *_SPAN), "cell")
        held = bins.withColumns({"first": first, "last": last}).where("first <= last")
        one = (F.col("v_lo") == F.col("v_hi")) & (F.col("id_lo") == F.col("id_hi"))
        done = held.where(one).select("cell", F.explode(F.sequence("first", "last")).alias("cut"), F.col("v_lo").alias("v"), F.col("id_lo").alias("id"))
        found = done if found is None else found.unionByName(done)
        state = held.where(~one).select("cell", F.concat_ws(".", "path", F.col("bin").cast("string")).alias("path"), "base", "total", *_SPAN)
        if state.isEmpty():
            return found, histogram
        rows = rows.select("cell", F.concat_ws(".", "path", F.col("bin").cast("string")).alias("path"), "_key", "record_id")


def _slab_among(cuts: Column, key: Column, record_id: Column) -> Column:
    """How many of ``cuts`` (array of v, id) are at or before a row."""
    return F.size(F.filter(cuts, lambda c: (c["v"] < key) | ((c["v"] == key) & (c["id"] <= record_id))))


def _with_slab(points: DataFrame, slabs: int, up: bool) -> DataFrame:
    """``points`` (with cell and _key) with their ``slab``, from 0 to ``slabs`` - 1, in their cell.

    The cuts are joined to the points, without a hint: where they are too many
    to be sent to every task, Spark shuffles both.
    """
    if slabs <= 1:
        return points.withColumn("slab", F.lit(0).cast("long"))
    cuts, histogram = rank_cuts(points.select("cell", "_key", "record_id"), slabs, up)
    if slabs <= FEW_CUTS:
        lists = stored(cuts.groupBy("cell").agg(F.collect_list(F.struct("v", "id")).alias("cuts")), "cell-cuts")
        return points.join(lists, "cell").withColumn("slab", _slab_among(F.col("cuts"), F.col("_key"), F.col("record_id")).cast("long")).drop("cuts")
    # Many cuts: those of one bin are compared with its rows, what lies before is known from the bin's rank.
    spans = histogram.select("cell", *_SPAN).distinct()
    binned = cuts.select("cell", F.col("v").alias("_key"), F.col("id").alias("record_id")).join(spans, "cell").withColumn("bin", _bin())
    lists = binned.groupBy("cell", "bin").agg(F.collect_list(F.struct(F.col("_key").alias("v"), F.col("record_id").alias("id"))).alias("cuts"))
    lowest, _ = _cuts_inside(slabs, up)
    table = histogram.withColumn("before", lowest - 1).select("cell", "bin", "before").join(lists, ["cell", "bin"], "left")
    table = stored(table.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<v:double,id:bigint>>"))), "cell-cuts")
    placed = points.join(stored(spans, "cell-spans"), "cell").withColumn("bin", _bin()).drop(*_SPAN).join(table, ["cell", "bin"])
    return placed.withColumn("slab", F.col("before") + _slab_among(F.col("cuts"), F.col("_key"), F.col("record_id"))).drop("bin", "before", "cuts")


@dataclass(frozen=True)
class Cuts:
    """A level of cells: each cell is cut into ``slabs`` along ``axis``, at the rows (value, id) of ``values`` and ``ids``.

    The cuts of a cell lie together, in order; a row at a cut is after it.
    Without ``ids`` rows with a cut's value are before it.
    """

    axis: int
    slabs: int
    values: np.ndarray
    ids: np.ndarray | None = None


def _table_of(spark: SparkSession, level: Cuts) -> Column:
    """struct(v, id) of the cuts as arrays: one constant of the plan while it is short, else a scalar subquery."""
    ids = [] if level.ids is None else level.ids.tolist()
    if len(level.values) <= SHORT:
        array = lambda values, kind: F.expr(f"cast(array({', '.join(values)}) AS array<{kind}>)")
        return F.struct(array((f"{v!r}D" for v in level.values.tolist()), "double").alias("v"), array(map(str, ids), "bigint").alias("id"))
    table = pa.table({"v": pa.array([level.values.tolist()], pa.list_(pa.float64())), "id": pa.array([ids], pa.list_(pa.int64()))})
    return spark.createDataFrame(table).select(F.struct("v", "id")).scalar()


def assign(points: DataFrame, levels: Sequence[Cuts]) -> DataFrame:
    """``points`` (record_id, features) with their ``cell``, numbered level by level from 0.

    The cuts go to the tasks as the one value of a scalar subquery, and each
    level is a binary search in generated code: no join, and no point moves.
    Each step names the one before several times.  Where the optimizer writes
    a column out, to push a filter down or to follow a join's key to its table,
    that multiplies step by step; so ``cell`` comes out of a generator, which
    isn't seen through.
    """
    spark, out = points.sparkSession, points.withColumn("cell", F.lit(0).cast("long"))
    levels = [level for level in levels if level.slabs > 1]
    for level in levels:
        cuts = _table_of(spark, level)
        x, first = F.col("features")[level.axis].cast("double"), F.col("cell") * (level.slabs - 1)
        out = out.withColumn("_slab", F.lit(0).cast("long"))
        for bit in reversed(range((level.slabs - 1).bit_length())):
            at = (first + F.col("_slab") + ((1 << bit) - 1)).cast("int")
            v = F.get(cuts["v"], at)
            after = x > v if level.ids is None else (x > v) | ((x == v) & (F.col("record_id") >= F.get(cuts["id"], at)))
            inside = F.col("_slab") + (1 << bit) < level.slabs
            out = out.withColumn("_slab", F.col("_slab") + F.when(inside & after, 1 << bit).otherwise(0))
        out = out.withColumn("cell", F.col("cell") * level.slabs + F.col("_slab")).drop("_slab")
    return out.withColumn("cell", F.explode(F.array("cell"))) if levels else out


def _cells_of(counted: DataFrame) -> dict[str, np.ndarray]:
    """A histogram (group, bin, n and the span of each bin) by group and bin."""
    table = counted.select("group", "bin", "n", *_SPAN).toArrow().sort_by([("group", "ascending"), ("bin", "ascending")])
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _find_cuts(celled: DataFrame, axis: int, cells: int, slabs: int, up: bool, span: Sequence[float]) -> Cuts:
    """The cuts of all ``cells`` of ``celled`` (cell, record_id, features), by histograms that come to the driver.

    These have at most HISTOGRAM bins in all, or 16 a cell.  A round looks into
    the bins that hold a cut, until a bin holds one row or they hold FEW_ROWS in
    all, which are then fetched.
    """
    spark = celled.sparkSession
    rows = celled.select(F.col("cell").alias("group"), F.col("features")[axis].cast("double").alias("_key"), "record_id")
    rows = rows.withColumns({c: F.lit(v) for c, v in zip(_SPAN, span, strict=True)})
    values, ids = np.zeros((cells, slabs - 1)), np.zeros((cells, slabs - 1), dtype=np.int64)
    cell_of, base_of, totals = np.arange(cells), np.zeros(cells, dtype=np.int64), None

    def cut_range(base: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = (base - 1) * slabs // total + 1 if up else -(-base * slabs // total)
        hi = (base + n - 1) * slabs // total if up else -(-(base + n) * slabs // total) - 1
        return np.maximum(lo, 1), np.minimum(hi, slabs - 1)

    def keep(cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, v: np.ndarray, named: np.ndarray) -> None:
        for c, a, b, x, i in zip(cell, lo, hi, v, named, strict=True):
            values[c, a - 1 : b], ids[c, a - 1 : b] = x, i

    while True:
        bins = min(BINS, max(16, HISTOGRAM // len(cell_of)))
        rows = rows.withColumn("bin", _bin(bins))
        h = _cells_of(rows.groupBy("group", "bin").agg(*_spans()))
        ends = np.cumsum(h["n"])
        starts = np.flatnonzero(np.diff(h["group"], prepend=-1))
        within = ends - h["n"] - np.repeat((ends - h["n"])[starts], np.diff(np.append(starts, len(ends))))
        cell, base = cell_of[h["group"]], base_of[h["group"]] + within
        if totals is None:
            totals = np.bincount(h["group"], weights=h["n"], minlength=cells).astype(np.int64)
        lo, hi = cut_range(base, h["n"], totals[cell])
        one = (h["v_lo"] == h["v_hi"]) & (h["id_lo"] == h["id_hi"])
        keep(*(x[(lo <= hi) & one] for x in (cell, lo, hi, h["v_lo"], h["id_lo"])))
        open_ = np.flatnonzero((lo <= hi) & ~one)
        if not len(open_):
            break
        picked = pa.table({"group": h["group"][open_], "bin": h["bin"][open_], "next": np.arange(len(open_)), **{c: h[c][open_] for c in _SPAN}})
        rows = rows.select("group", "bin", "_key", "record_id").join(F.broadcast(spark.createDataFrame(picked)), ["group", "bin"])  # a row a cut at most
        rows = rows.select(F.col("next").alias("group"), "_key", "record_id", *_SPAN)
        cell_of, base_of = cell[open_], base[open_]
        if h["n"][open_].sum() <= FEW_ROWS:
            left = rows.select("group", "_key", "record_id").toArrow().sort_by([("group", "ascending"), ("_key", "ascending"), ("record_id", "ascending")])
            group = left.column("group").to_numpy()
            rank = np.arange(len(group)) - np.searchsorted(group, group)
            base = base_of[group] + rank
            lo, hi = cut_range(base, np.ones_like(base), totals[cell_of[group]])
            keep(*(x[lo <= hi] for x in (cell_of[group], lo, hi, left.column("_key").to_numpy(), left.column("record_id").to_numpy())))
            break
    return Cuts(axis, slabs, values.reshape(-1), ids.reshape(-1))


def _extent(points: DataFrame, dims: int) -> tuple[int, list[list[float]]]:
    """(rows; for each axis the least and greatest value and record_id), in one pass."""
    ends = [f(F.col("features")[i].cast("double")) for i in range(dims) for f in (F.min, F.max)]
    row = points.agg(F.count("*"), F.min("record_id"), F.max("record_id"), *ends).first()
    return row[0], [[row[3 + 2 * i], row[4 + 2 * i], row[1], row[2]] for i in range(dims)]


def exact_splits(points: DataFrame, depth: int, dims: int) -> list[Cuts]:
    """The medians of every level of cells over ``points`` (record_id, features)."""
    rows, spans = _extent(points, dims)
    levels: list[Cuts] = []
    for level in range(depth if rows else 0):
        axis = level % dims
        levels.append(_find_cuts(assign(points, levels), axis, 1 << level, 2, False, spans[axis]))
    return levels


def kd_cells_exact(points: DataFrame, depth: int, dims: int) -> DataFrame:
    """Add ``cell`` (0 to 2**depth - 1): each level halves every cell at its exact median.

    Level l orders by axis l mod dims, then record_id; the lower half takes
    n div 2 points, so equal points never overfill a cell.
    """
    return assign(points, exact_splits(points, depth, dims)).withColumn("cell", F.col("cell").cast("int"))


def sampled_splits(points: DataFrame, depth: int, dims: int, sample: int = 100_000) -> list[Cuts]:
    """The medians of about ``sample`` points, which come to the driver with ``dims`` components each."""
    part = min(1.0, sample / max(1, points.count()))
    drawn = points.where(F.pmod(F.xxhash64("record_id"), F.lit(1 << 20)) < int(part * (1 << 20))).select(F.slice("features", 1, dims).alias("features")).toArrow()
    x = drawn.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(drawn), dims)
    cell, out = np.zeros(len(x), dtype=np.int64), []
    for level in range(depth):
        key, splits = x[:, level % dims], np.zeros(1 << level)
        order = np.lexsort((key, cell))
        cells, starts, counts = np.unique(cell[order], return_index=True, return_counts=True)
        splits[cells] = key[order][starts + (counts - 1) // 2]
        out.append(Cuts(level % dims, 2, splits))
        cell = cell * 2 + (key > splits[cell])
    return out


def kd_cells(points: DataFrame, depth: int, dims: int, sample: int = 100_000) -> DataFrame:
    """Add ``cell`` by the medians of about ``sample`` points, without moving a point.

    Cells are only nearly balanced, which pruning doesn't mind: it goes by the
    boxes of all their points.
    """
    return assign(points, sampled_splits(points, depth, dims, sample)).withColumn("cell", F.col("cell").cast("int"))


def str_leaves(points: DataFrame, leaf_size: int, dims: int) -> DataFrame:
    """Add ``cell`` by sort-tile-recursive packing (Leutenegger, Lopez, Edgington 1997).

    Axis by axis, every slab is cut, in the order of that axis and record_id,
    into slabs of equal counts, so that a leaf holds at most ``leaf_size`` points
    or one more by rounding.  Up to DRIVER_CUTS cuts are held as a table that all
    tasks get; the cuts of more leaves stay in tables that are joined to the
    points (``rank_cuts``).
    """
    rows, spans = _extent(points, dims)
    left, cells, levels, out = max(1, math.ceil(rows / leaf_size)), 1, [], None
    for axis in range(dims):
        slabs = math.ceil(left ** (1 / (dims - axis)) - 1e-9)
        left = math.ceil(left / slabs)
        if out is None and cells * slabs <= DRIVER_CUTS:
            levels += [_find_cuts(assign(points, levels), axis, cells, slabs, True, spans[axis])] if slabs > 1 else []
            cells *= slabs
            continue
        out = assign(points, levels) if out is None else out
        out = _with_slab(out.withColumn("_key", F.col("features")[axis].cast("double")), slabs, True)
        out = out.withColumn("cell", F.col("cell") * slabs + F.col("slab")).drop("_key", "slab")
    return assign(points, levels) if out is None else out


def zone_map(celled: DataFrame, dims: int, *more: str) -> DataFrame:
    """cell, n, lo, hi of every cell, after the columns ``more`` that a cell has one value of."""
    return bounding_boxes(celled, [*more, "cell"], dims)


def levels(zones: DataFrame, fanout: int, dims: int) -> DataFrame:
    """level, node, n, lo, hi: the zone map as level 0 and the boxes of ``fanout`` nodes each above, up to one root.

    An empty zone map has no level.
    """
    level = zones.select(F.lit(0).alias("level"), F.col("cell").cast("long").alias("node"), "n", "lo", "hi")
    out, top, n = level, 0, zones.agg(F.max("cell")).first()[0]
    while n is not None and n > 0:
        parent = level.withColumn("node", F.floor(F.col("node") / fanout))
        ends = [f(F.col(c)[i]).alias(f"_{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
        top, n = top + 1, n // fanout
        level = parent.groupBy("node").agg(F.sum("n").alias("n"), *ends).select(F.lit(top).alias("level"), "node", "n", F.array(*[f"_lo{i}" for i in range(dims)]).alias("lo"), F.array(*[f"_hi{i}" for i in range(dims)]).alias("hi"))
        out = out.unionByName(level)
    return out


def tree_height(zones: DataFrame, fanout: int, dims: int) -> DataFrame:
    """height: the number of levels; 1 for an empty tree."""
    return levels(zones, fanout, dims).agg(F.coalesce(F.max("level") + 1, F.lit(1)).cast("int").alias("height"))
