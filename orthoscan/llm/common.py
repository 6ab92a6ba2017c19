"""What the operators of this subpackage share: tables, scratch and text rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.functions.vectors import is_valid
from orthoscan.sources.scratch import scratch_root, stored

__all__ = ["LOWER", "SPACES", "UPPER", "arrow_rows", "ascii_lower", "checkpoint_folder", "clean_vectors", "freed", "giving_back", "id_remainder", "scratch_root", "stored", "table", "text_slices", "texts_of", "vector_matrix"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The ASCII white space that separates words, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, read by Spark only (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` has a fast path for pure ASCII and does the same there; other
    texts go through ``translate``, which leaves letters such as É alone.
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the folds of the contracts.

    A null id counts as the empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def text_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``most`` bytes of text, or one row, so that a worker's memory doesn't follow the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(batch):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def texts_of(column: pa.Array) -> pa.Array:
    """A column of strings, nulls empty, in buffers of its own: Arrow's string functions misread some slices."""
    return pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), "")


@contextmanager
def arrow_rows(spark: SparkSession, most: int = 1000) -> Iterator[None]:
    """Jobs begun inside send at most ``most`` rows at a time to Python; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _give_back() -> None:
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each the worker gives back what it doesn't use, so that a long task doesn't pile it up."""
    for batch in batches:
        yield batch
        _give_back()


def freed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which the task's worker gives the memory that it doesn't use back: idle workers stay beside those of later stages."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has a folder: the shared one, unless the context has taken it from its settings."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def clean_vectors(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(rows whose ``column`` holds a usable vector, its length).

    Null and empty vectors and those with null or non-finite components are
    dropped, and so are those of another length than most rows have, the
    longer of two equally frequent lengths.
    """
    v = F.col(column)
    usable = vectors.where(F.coalesce((F.size(v) > 0) & is_valid(v, F.size(v)), F.lit(False)))
    lengths = usable.groupBy(F.size(v).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    dims = lengths["length"] if lengths else 0
    return usable.where(F.size(v) == dims), dims


def vector_matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length, without nulls, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 0)
