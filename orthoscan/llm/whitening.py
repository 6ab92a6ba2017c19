"""Whitening of embeddings by their leading principal components.

The components come from Chebyshev-filtered subspace iteration (Zhou, Saad,
Tiago, Chelikowsky 2006).  The covariance is never formed: a pass over the
distributed rows gives V Q = (1/n) sum of (x - mean) (x - mean)' Q for a block Q
of a few columns.  A polynomial recurrence of such passes damps the spectrum
from zero to the least Ritz value of the block, which holds what isn't wanted;
then the block is made orthonormal (QR) and rotated to its Ritz vectors.  Pairs
whose residual is at rounding level are locked: the recurrence leaves them out,
so that a dominant direction can't drown the others.  Iteration ends when all
wanted pairs are certified by their residuals.

The driver holds blocks of dimensions x columns; a pass sends as many numbers
per task, added up in a tree before they come back.  The rows are an RDD of
matrices, persisted and made from a stored table: dozens of passes over the same
rows, each a sum of matrix products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.llm.common import clean_vectors, stored, table, vector_matrix

COMPONENTS, SCALE = 4, 256
#: Columns of the block, for each component wanted; and a seed for the first block.
COLUMNS, SEED = 6, 17
#: Passes of one filter at most, and how much more it may enlarge the first wanted direction than the edge of the damped part.
DEGREE, SPREAD = 24, 1e6
#: Residuals at this part of the largest eigenvalue certify a pair; OUTER filters are tried, and STALE of them without a gain end the search.
CERTIFIED, OUTER, STALE = 2e-14, 60, 2
#: Residuals above this part of the largest eigenvalue are an error.
WORST = 1e-10
#: Eigenvalues below this part of the trace count as none.
NOTHING = 1e-13
#: Integer components beyond this count as it, so that all integers are exact in doubles.
LIMIT = 1 << 40


@dataclass
class Whitener:
    """The mean is sums / n; ``vectors`` has a unit eigenvector a column, by falling ``values``; ``residual`` is the worst."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float = 0.0
    identity_error: float = 0.0
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sums)^2, exactly; None where it doesn't fit a long."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * x.astype(np.int64) - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles, which hold them exactly; never -0."""
    return np.clip(np.floor(SCALE * vectors), -LIMIT, LIMIT) + 0.0


def _fit_list(kept: DataFrame) -> DataFrame:
    """Each distinct integer vector once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.unique(integers(vector_matrix(batch.column(0))).astype(np.int64), axis=0)
            ends = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))], ["x"])

    return kept.select("features").mapInArrow(cut, "x array<long>").distinct()


def _sums(fit: DataFrame, dims: int) -> tuple[list[int], int]:
    """Exact sums of every axis, and the number of rows."""
    each = fit.select(F.posexplode("x").alias("axis", "v")).groupBy("axis").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    out = [0] * dims
    for r in each:
        out[r.axis] = int(r.s)
    return out, each[0].n if each else 0


def _blocks(fit: DataFrame, dims: int) -> RDD:
    """The stored fit list as blocks of doubles that stay in the executors' memory, or on their disks, between passes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([vector_matrix(batch.column(0)).tobytes()], pa.binary())], ["block"])

    return fit.mapInArrow(pack, "block binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])).reshape(-1, dims)).persist(StorageLevel.MEMORY_AND_DISK)


def _added(blocks: RDD, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``of(block)`` over all blocks, added up in a tree of tasks."""
    return blocks.treeAggregate(np.zeros(shape), lambda total, x: total + of(x), np.add)


class _Passes:
    """V Q for blocks Q, by passes over the fit list; and the trace of V."""

    def __init__(self, blocks: RDD, n: int, mean: np.ndarray):
        self.blocks, self.n, self.mean, self.count, self.trace = blocks, n, mean, 0, 0.0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        mean = self.mean

        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return np.column_stack([centred.T @ (centred @ q), (centred * centred).sum(axis=0)])

        out = _added(self.blocks, (len(mean), q.shape[1] + 1), of)  # dimensions x columns, to the tasks and back
        self.count, self.trace = self.count + 1, float(out[:, -1].sum()) / self.n
        return out[:, :-1] / self.n


def _grown(value: float, edge: float) -> float:
    """Growth a pass, as an exponent, of the direction of an eigenvalue beyond the damped part 0 to ``edge``."""
    return float(np.arccosh(max(1.0, 2 * value / edge - 1)))


def _filtered(apply: _Passes, q: np.ndarray, edge: float, degree: int, locked: np.ndarray) -> np.ndarray:
    """The Chebyshev polynomial of V that is small from 0 to ``edge``, applied to ``q``; rescaled as it grows."""
    half = edge / 2
    out = lambda y: y - locked @ (locked.T @ y)
    step = lambda y: (out(apply(y)) - half * y) / half
    before, now = q, step(q)
    for _ in range(degree - 1):
        before, now = now, 2 * step(now) - before
        size = np.linalg.norm(now, axis=0)
        size[size == 0] = 1.0
        before, now = out(before / size), out(now / size)
    return now


def leading(apply: _Passes, dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors a column, worst residual) of the ``wanted`` leading pairs."""
    columns = min(dims, COLUMNS * wanted)
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((dims, columns)))[0]
    best, stale = np.inf, 0
    for _ in range(OUTER):
        y = apply(q)
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, q, y = values[order], q @ turn[:, order], y @ turn[:, order]
        top = max(values[0], 1e-300)
        residuals = np.linalg.norm(y - q * values, axis=0)
        worst = float(residuals[:wanted].max())
        if best is np.inf or worst < best[0]:
            stale = 0 if best is np.inf or worst < best[0] / 2 else stale + 1
            best = (worst, values[:wanted], q[:, :wanted])
        else:
            stale += 1
        if columns == dims or worst <= CERTIFIED * top or (stale >= STALE and best[0] <= WORST * top) or values[columns - 1] <= 0:
            break
        done = 0
        while done < wanted - 1 and residuals[done] <= 8 * CERTIFIED * top:
            done += 1
        edge = float(values[columns - 1])
        spread = _grown(values[done], edge) - _grown(values[wanted - 1], edge)
        degree = int(max(2, min(DEGREE, np.log(SPREAD) / max(spread, 1e-9))))
        moved = _filtered(apply, q[:, done:], edge, degree, q[:, :done])
        q = np.linalg.qr(np.column_stack([q[:, :done], moved]))[0]
    return best[1], best[2], best[0]


def fit_whitener(kept: DataFrame, dims: int, components: int = COMPONENTS) -> Whitener | None:
    """The leading components of the distinct integer vectors of ``kept`` (features); None without rows.

    Directions without variance are left out, so there may be fewer components
    than asked for, or none.  A residual that doesn't reach WORST raises
    ArithmeticError.
    """
    fit = stored(_fit_list(kept), "whitening-fit")
    sums, n = _sums(fit, dims)
    if not n:
        return None
    blocks = _blocks(fit, dims)
    apply = _Passes(blocks, n, np.array([s / n for s in sums]))
    values, vectors, residual = leading(apply, dims, min(dims, components))
    if residual > WORST * max(values[0], 1e-300) and values[0] > 0:
        raise ArithmeticError(f"residual {residual:g} for the eigenvalue {values[0]:g}")
    there = values > NOTHING * max(apply.trace, 1e-300)
    found = Whitener(n, sums, values[there], vectors[:, there], apply.trace, residual)
    k = int(there.sum())
    if k:

        def moments(x: np.ndarray) -> np.ndarray:
            w = found.whiten(x)
            return np.column_stack([w.T @ w, w.sum(axis=0)])

        both = _added(blocks, (k, k + 1), moments) / n
        found.identity_error = float(np.abs(both[:, :k] - np.outer(both[:, k], both[:, k]) - np.eye(k)).max())
    blocks.unpersist()
    found.passes = apply.count
    return found


def whitened(kept: DataFrame, found: Whitener | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row of ``kept`` and component."""
    shared = kept.sparkSession.sparkContext.broadcast(found)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k = len(w.values) if w else 0
        for batch in batches if k else ():
            x, m = integers(vector_matrix(batch.column(1))), len(batch)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                pa.array(w.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.whiten(x).reshape(-1)),
                pa.array(np.tile(w.values / w.trace, m)), pa.array(np.full(m * k, w.identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = dict(kept.dtypes)["vec_id"]
    return kept.select("vec_id", "features").mapInArrow(rows, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vectors`` (vec_id and ``column``) whitened: a row for each usable row and component, see ``whitened``.

    Rows whose vector is null or empty, or holds null or non-finite components,
    are dropped, and so are vectors of another length than most (the longer of
    two equally frequent lengths).  Repeated vectors count once in the fit, and
    each of their rows is returned; null ids are kept.  Directions without
    variance have no rows, so one distinct vector or an empty table gives none.
    Among equal eigenvalues any orthonormal choice is right; it is the same for
    all rows.  ``deviation`` is null where it doesn't fit a long.  Components
    beyond 2 ** 40 count as that.  Other columns are ignored.
    """
    kept, dims = clean_vectors(vectors.select("vec_id", F.col(f"`{column}`").alias("features")), "features")
    return whitened(kept, fit_whitener(kept, dims, components) if dims else None)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
