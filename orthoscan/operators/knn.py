"""Exact nearest neighbours of one query by a full scan.

The order is (distance, record_id) throughout.  Batches of queries are joined
with the points in ``operators.knn_join``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthoscan.functions.vectors import distance


def check_dims(points: DataFrame, query: Sequence[float], features: str = "features") -> None:
    """Raise ValueError unless the query is as long as the first stored point."""
    row = points.select(F.size(features)).first()
    if row is not None and row[0] != len(query):
        raise ValueError(f"the query has {len(query)} dimensions, the points have {row[0]}")


def knn(points: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The ``k`` points (record_id, features) nearest to ``query``: record_id, features, distance, rank.

    Fewer points give fewer rows, and k <= 0 or an empty table none.  A query
    of another length raises ValueError.  Each task keeps k rows.
    """
    check_dims(points, query)
    found = points.select("record_id", "features", distance(F.col("features"), query).alias("distance")).orderBy("distance", "record_id").limit(max(0, k))
    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", "record_id")))  # k rows


def _as_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_rows(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least by (distance, id)."""
    at = np.arange(len(d))
    if len(d) > 4 * k:
        at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])  # ties of the k-th stay
    return at[np.lexsort((ids[at], d[at]))[:k]]


def knn_prefixes(points: DataFrame, query: Sequence[float], k: int, dims: Sequence[int]) -> DataFrame:
    """dims, rank, record_id, distance: the ``k`` nearest points to ``query`` over each prefix of the vectors, in one scan.

    A prefix's squared distance is a running sum, so all of them come from one
    pass over a point; a task keeps k rows for each of ``dims`` while it reads,
    and those are merged.  Prefixes longer than the query raise ValueError;
    points shorter than a prefix aren't found by it.
    """
    wanted = sorted(set(dims))
    if wanted and wanted[-1] > len(query):
        raise ValueError(f"the query has {len(query)} dimensions, {wanted[-1]} are asked for")
    target = np.asarray(query, dtype=np.float64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: (np.zeros(0), np.zeros(0, dtype=np.int64)) for d in wanted}
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy()
            for length in np.unique(lengths):
                own = batch if (lengths == length).all() else batch.filter(pa.array(lengths == length))
                gap = _as_matrix(own.column(1)) - target[:length]
                ids, running = own.column(0).to_numpy(), np.cumsum(gap * gap, axis=1)
                for d in wanted if k > 0 else ():
                    if d <= length:
                        far, named = np.concatenate([best[d][0], running[:, d - 1]]), np.concatenate([best[d][1], ids])
                        at = nearest_rows(named, far, k)
                        best[d] = far[at], named[at]
        for d, (far, named) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(far), d, dtype=np.int32)), pa.array(named), pa.array(np.sqrt(far))], ["dims", "record_id", "distance"])

    prefix = F.slice("features", 1, max(wanted, default=1))
    found = points.select("record_id", prefix.alias("features")).where(F.col("features").isNotNull()).mapInArrow(search, "dims int, record_id long, distance double")
    turn = Window.partitionBy("dims").orderBy("distance", "record_id")
    return found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("dims", "rank", "record_id", "distance")
