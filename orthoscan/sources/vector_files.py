"""Vector files of fixed layouts, as Python Data Sources.

``paged_vectors``: 4096-byte pages, little-endian; page 0 holds the number of
records and of pages, every other page a count and that many float32 vectors.
``bin_vectors``: int32 count, int32 dimensions, then the float32 matrix.

A path is one such file, or a folder of them as Spark writes them: every task
writes a file of its own, named by its first record_id, so tables of any size
are written and read in parallel.  They get their names when all tasks have
ended, so a failed job leaves nothing that is read.  Files are opened through pyarrow's file
systems, so a path may be local or an address of a store.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PAGE = 4096
#: Bytes that one task reads.
SPLIT_BYTES = 32 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def per_page(dims: int) -> int:
    return (PAGE - 4) // (4 * dims)


class _Part(InputPartition):
    """Rows ``first`` to ``last`` of a file whose first record_id is ``base``."""

    def __init__(self, path: str, base: int, first: int, last: int, dims: int):
        self.path, self.base, self.first, self.last, self.dims = path, base, first, last, dims


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dims = options["path"], int(options.get("dims", 0))

    def _read(self, path: str, at: int, size: int) -> bytes:
        system, _ = _system(self.path)
        with system.open_input_file(path) as f:
            return f.read_at(size, at)

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, inner = _system(self.path)
        if system.get_file_info(inner).type == fs.FileType.File:
            return [(inner, 0)]
        found = [(f.path, re.search(r"part-(\d+)\.vec$", f.path)) for f in system.get_file_info(fs.FileSelector(inner))]
        return sorted((path, int(m[1])) for path, m in found if m)

    def partitions(self) -> Sequence[InputPartition]:
        parts = []
        for path, base in self._files():
            rows, dims = self.shape(path)
            step = max(1, SPLIT_BYTES // max(1, 4 * dims)) // self.unit(dims) * self.unit(dims) or self.unit(dims)
            parts += [_Part(path, base, r, min(r + step, rows), dims) for r in range(0, rows, step)]
        return parts or [_Part("", 0, 0, 0, 1)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part.last > part.first:
            vectors = self.vectors(part)
            n = part.last - part.first
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * part.dims + 1, part.dims, dtype=np.int32)), pa.array(np.ascontiguousarray(vectors, dtype=np.float32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + part.base + part.first), lists], ["record_id", "features"])


class _PagedReader(_Reader):
    def shape(self, path: str) -> tuple[int, int]:
        return struct.unpack("<i", self._read(path, 0, 4))[0], self.dims

    def unit(self, dims: int) -> int:
        return per_page(dims)

    def vectors(self, part: _Part) -> np.ndarray:
        size = per_page(part.dims)
        first, last = part.first // size, -(-part.last // size)
        pages = np.frombuffer(self._read(part.path, PAGE * (1 + first), PAGE * (last - first)), dtype=np.uint8).reshape(-1, PAGE)
        return np.ascontiguousarray(pages[:, 4 : 4 + 4 * size * part.dims]).view("<f4").reshape(-1, part.dims)[: part.last - part.first]


class _BinReader(_Reader):
    def shape(self, path: str) -> tuple[int, int]:
        return struct.unpack("<ii", self._read(path, 0, 8))

    def unit(self, dims: int) -> int:
        return 1

    def vectors(self, part: _Part) -> np.ndarray:
        data = self._read(part.path, 8 + 4 * part.dims * part.first, 4 * part.dims * (part.last - part.first))
        return np.frombuffer(data, "<f4").reshape(-1, part.dims)


def paged_bytes(vectors: np.ndarray) -> bytes:
    """One paged file."""
    n, dims = vectors.shape
    size = per_page(dims)
    out = [struct.pack("<ii", n, 1 + -(-n // size)).ljust(PAGE, b"\0")]
    for k in range(0, n, size):
        rows = vectors[k : k + size]
        out.append((struct.pack("<i", len(rows)) + rows.astype("<f4").tobytes()).ljust(PAGE, b"\0"))
    return b"".join(out)


def bin_bytes(vectors: np.ndarray) -> bytes:
    """One matrix file."""
    return struct.pack("<ii", *vectors.shape) + vectors.astype("<f4").tobytes()


@dataclass
class _Written(WriterCommitMessage):
    """A file that a task has written under a temporary name, and the name it gets; no names from a task without rows."""

    temporary: str | None = None
    final: str | None = None


class _Writer(DataSourceArrowWriter):
    """A file for each task; its rows come with ascending, dense record_ids.

    Tasks write to a folder of the job, which readers don't look into.  When all
    have ended, their files are moved to their places; when one fails for good,
    the folder goes, with what failed attempts have left; attempts that end later
    can only leave files in such a folder.  Rows stay in Arrow
    batches; a task holds the floats of its file.
    """

    def __init__(self, options: dict, to_bytes):
        self.path, self.to_bytes, self.folder = options["path"], to_bytes, f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        held, due = [], None
        for batch in batches:
            ids = batch.column("record_id").to_numpy()
            if len(ids):
                due = int(ids[0]) if due is None else due
                if not np.array_equal(ids, np.arange(due, due + len(ids))):
                    raise ValueError(f"record_ids from {ids[0]} to {ids[-1]} aren't the {len(ids)} from {due} on")
                due += len(ids)
                held.append(batch.column("features").flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(ids), -1))
        if not held:
            return _Written()
        rows = np.concatenate(held)
        system, inner = _system(self.path)
        system.create_dir(f"{inner}/{self.folder}", recursive=True)
        temporary = f"{inner}/{self.folder}/{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            out.write(self.to_bytes(rows))
        return _Written(temporary, f"{inner}/part-{due - len(rows):020d}.vec")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = _system(self.path)
        done = [m for m in messages if m is not None and m.final]
        there = [m.final for m, info in zip(done, system.get_file_info([m.final for m in done]), strict=True) if info.type.name != "NotFound"]
        if there:
            self.abort(messages)
            raise ValueError(f"{there[0]} is there already")
        system.create_dir(inner, recursive=True)
        for m in done:
            system.move(m.temporary, m.final)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inner = _system(self.path)
        if system.get_file_info(f"{inner}/{self.folder}").type.name != "NotFound":
            system.delete_dir(f"{inner}/{self.folder}")


class PagedVectors(DataSource):
    """Options: path, dims."""

    @classmethod
    def name(cls) -> str:
        return "paged_vectors"

    def schema(self) -> str:
        return "record_id long, features array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, paged_bytes)


class BinVectors(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "bin_vectors"

    def schema(self) -> str:
        return "record_id long, features array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _BinReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, bin_bytes)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedVectors)
    spark.dataSource.register(BinVectors)


def read_paged(spark: SparkSession, path: str, dims: int) -> DataFrame:
    register(spark)
    return spark.read.format("paged_vectors").option("dims", dims).load(path)


def read_bin(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("bin_vectors").load(path)


def _write(points: DataFrame, path: str, layout: str) -> None:
    register(points.sparkSession)
    rows = points.select("record_id", "features").repartitionByRange("record_id").sortWithinPartitions("record_id")
    rows.write.format(layout).mode("append").save(path)


def write_paged(points: DataFrame, path: str) -> None:
    """Write points with dense record_ids into a new folder."""
    _write(points, path, "paged_vectors")


def write_bin(points: DataFrame, path: str) -> None:
    """Write points with dense record_ids into a new folder."""
    _write(points, path, "bin_vectors")
