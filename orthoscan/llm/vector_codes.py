"""Vector codes: product quantisation, fitted by Lloyd rounds over members that stay where they are.

A vector becomes integers and is cut into parts; each part position has a
codebook.  A part is a member of an owner, which is (position, entry, salt):
members are dealt to partitions by owner once.  In a round every owner sums the
members it holds, the sums of an entry's owners give the entry's new value, and
then each member looks for its nearest entry: those that find another one than
before move to its owner in the round's shuffle, all others stay in their
partition.  Equal parts are folded into one member with a weight before they
are sent, and the salt is a hash of the part, so that a vector that a third of
the rows repeat is a member or two, and a popular entry has many owners.

Per-partition state that outlives a shuffle has no DataFrame form: a Python
step loses the planner's knowledge of the partitioning, and everything would be
shuffled.  So members are blocks of an RDD with a partitioner; stayers and
arrivals are united partition by partition.  Each round's blocks are
checkpointed, so a lost executor costs one round of its partitions.

The driver holds codebooks and their sums: parts x entries x width numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.llm.common import checkpoint_folder, clean_vectors, stored, table, vector_matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: An entry has at least so many owners, and one more for each so many rows.
SALTS, SALT_ROWS = 16, 1 << 20
#: Members in a block, at most.
BLOCK = 1 << 16


@dataclass
class Codebooks:
    """``entries[position, entry]`` are the integer components of an entry; ``limit`` bounds a component's size."""

    entries: np.ndarray
    limit: int
    scale: int = SCALE

    def integers(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of floor(scale * x), cut into parts: rows x positions x width; components beyond ``limit`` count as that."""
        return _integers(vectors, self.entries.shape[0], self.limit, self.scale)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every part of every row, and the rows' squared distances summed over parts."""
        parts = self.integers(vectors)
        found = [nearest(parts[:, p], book) for p, book in enumerate(self.entries)]
        return np.stack([e for e, _ in found], axis=1), sum(d for _, d in found)

    def digest(self) -> str:
        """SHA-256 of all components, comma-joined, by position, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _integers(vectors: np.ndarray, parts: int, limit: int, scale: int) -> np.ndarray:
    width = -(-vectors.shape[1] // parts)
    out = np.zeros((len(vectors), parts * width), dtype=np.int64)
    out[:, : vectors.shape[1]] = np.clip(np.floor(scale * vectors.astype(np.float64)), -limit, limit).astype(np.int64)
    return out.reshape(len(vectors), parts, width)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` (entries x width) to each row of ``parts``, the first on ties, and the squared distance."""
    far = np.stack([((parts - e) ** 2).sum(axis=1) for e in book], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(parts)), at]


def _folded(rows: np.ndarray) -> np.ndarray:
    """Rows of (position, part..., weight) with equal ones added up."""
    rows = rows[np.lexsort(rows[:, :-1].T)]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
    starts = np.flatnonzero(first)
    return np.column_stack([rows[starts, :-1], np.add.reduceat(rows[:, -1], starts)]) if len(rows) else rows


def _salt(parts: np.ndarray, salts: int) -> np.ndarray:
    mixed = np.zeros(len(parts), dtype=np.uint64)
    for column in parts.T:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(salts)).astype(np.int64)


def _dealt(rows: np.ndarray, entry: np.ndarray, entries: int, salts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, block) for members (position, part..., weight) that belong to ``entry``."""
    owner = (rows[:, 0] * entries + entry) * salts + _salt(rows[:, 1:-1], salts)
    order = np.argsort(owner, kind="stable")
    owner, rows = owner[order], rows[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for key, block in zip(owner[np.r_[0, cuts]] if len(owner) else (), np.split(rows, cuts), strict=False):
        for lo in range(0, len(block), BLOCK):
            yield int(key), block[lo : lo + BLOCK]


def _place(owner: int) -> int:
    """The partition of an owner, modulo their number: owners of one entry lie apart."""
    return owner * 2654435761 % (1 << 32) >> 7


def _members(kept: DataFrame, books: Codebooks, salts: int) -> RDD:
    """(owner, block) of every vector's parts, by the nearest entry of the first codebooks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = books.integers(vector_matrix(batch.column(0)))
            blocks: list[tuple[int, np.ndarray]] = []
            for p, book in enumerate(books.entries):
                rows = np.column_stack([np.full(len(parts), p), parts[:, p], np.ones(len(parts), dtype=np.int64)])
                rows = _folded(rows)
                blocks += _dealt(rows, nearest(rows[:, 1:-1], book)[0], len(book), salts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int64()), pa.array([b.tobytes() for _, b in blocks], pa.binary())], ["owner", "block"])

    width = books.entries.shape[2] + 2
    sent = kept.select("features").mapInArrow(cut, "owner long, block binary").rdd
    return sent.map(lambda r: (r[0], np.frombuffer(bytes(r[1]), dtype=np.int64).reshape(-1, width)))


def _merged(blocks: Iterable[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """What an owner holds, stayers and arrivals, in few blocks with equal members folded."""
    held: dict[int, list[np.ndarray]] = {}
    for owner, block in blocks:
        held.setdefault(owner, []).append(block)
    while held:
        owner, own = held.popitem()
        rows = own[0] if len(own) == 1 else _folded(np.concatenate(own))
        for lo in range(0, len(rows), BLOCK):
            yield owner, rows[lo : lo + BLOCK]


def _sums(blocks: Iterable[tuple[int, np.ndarray]], salts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position and entry, componentwise sum and count) over the members that a partition's owners hold."""
    out: dict[int, np.ndarray] = {}
    for owner, block in blocks:
        part, weight = block[:, 1:-1], block[:, -1:]
        own = np.append((part * weight).sum(axis=0), weight.sum())
        out[owner // salts] = out[owner // salts] + own if owner // salts in out else own
    yield from out.items()


def _reassigned(blocks: Iterable[tuple[int, np.ndarray]], books: np.ndarray, salts: int) -> Iterator[tuple[int, tuple[bool, np.ndarray]]]:
    """(owner, (whether it arrives there, block)): members whose nearest entry is another one now go to its owner."""
    entries = books.shape[1]
    for owner, block in blocks:
        position, entry = divmod(owner // salts, entries)
        found = nearest(block[:, 1:-1], books[position])[0]
        gone = found != entry
        if not gone.all():
            yield owner, (False, block[~gone])
        for to, rows in _dealt(block[gone], found[gone], entries, salts) if gone.any() else ():
            yield to, (True, rows)


def fit(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of ``kept`` (vec_id, features), of ``dims`` components each.

    They begin with the vectors of the smallest ids (null ids last, equal ids by
    their components); fewer rows than ``entries`` give fewer entries, none give
    none.  Every round assigns all parts and then replaces each entry by the
    componentwise floor of its parts' mean; an entry without parts stays.
    """
    spark = kept.sparkSession
    limit = isqrt((1 << 62) // max(1, dims)) // 2  # squared distances and their sums fit a long
    first = [r.features for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "features").limit(entries).collect()]
    books = Codebooks(_integers(np.array(first, dtype=np.float64).reshape(len(first), dims), parts, limit, scale).transpose(1, 0, 2), limit, scale)
    if not first:
        return books
    salts = max(SALTS, kept.count() // SALT_ROWS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * (salts - SALTS))
    width = books.entries.shape[2]
    checkpoint_folder(spark)
    members, held = _members(kept, books, salts).partitionBy(tasks, _place).mapPartitions(_merged, preservesPartitioning=True), []
    for turn in range(rounds):
        if turn:  # the first round's assignment dealt the members out
            shared = spark.sparkContext.broadcast(books.entries)
            state = members.mapPartitions(lambda x, b=shared: _reassigned(x, b.value, salts), preservesPartitioning=True)
            state.persist(StorageLevel.MEMORY_AND_DISK)
            state.checkpoint()
            held.append(state)
            stay = state.filter(lambda x: not x[1][0]).mapValues(lambda v: v[1])
            move = state.filter(lambda x: x[1][0]).mapValues(lambda v: v[1]).mapPartitions(list).partitionBy(tasks, _place)
            members = stay.union(move).mapPartitions(_merged, preservesPartitioning=True)
        found = members.mapPartitions(lambda x: _sums(x, salts)).reduceByKey(add, min(tasks, parts * len(first))).collect()  # a row an entry
        books.entries = books.entries.copy()
        for key, own in found:
            books.entries[divmod(key, len(first))] = np.floor_divide(own[:width], own[width])
        for old in held[:-1]:
            old.unpersist()
        held = held[-1:]
    for old in held:
        old.unpersist()
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (the entries' indexes, two hex digits each) and error (squared distances, summed over parts) of every row."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, error = shared.value.encode(vector_matrix(batch.column(2)))
            text = [bytes(row).hex() for row in at.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    of = dict(kept.dtypes)
    return kept.select("vec_id", "label", "features").mapInArrow(codes, f"vec_id {of['vec_id']}, label {of['label']}, code string, error long")


def vector_codes(vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error of every usable row of ``vectors``; the codebooks).

    Rows whose vector is null or empty, or holds null or non-finite components,
    are dropped, and so are vectors of another length than most (the longer of
    two equally frequent lengths).  Lengths that ``parts`` doesn't divide are
    filled up with zeros.  Repeated rows and ids give a row each; null ids are
    kept and count as largest.  ``label_error`` sums the errors of a label's
    rows, null labels together.  Components of a size that would overflow are
    cut off, at 32,768 for 64 dimensions.  At most 256 entries.  Other columns are
    ignored; an empty table gives no row.
    """
    kept, dims = clean_vectors(vectors.select("vec_id", "label", F.col(f"`{column}`").alias("features")), "features")
    books = fit(kept, dims, parts, entries, rounds)
    coded = stored(encode(kept, books), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(sums, coded["label"].eqNullSafe(sums["of_label"])).drop("of_label"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _lloyd_sql(rounds: int = ROUNDS) -> str:
    """The rounds written out, one step after the other."""
    down = lambda s, n: f"(({s} - ((({s}) % {n}) + {n}) % {n}) // {n})"  # noqa: E731  towards minus infinity
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, p, x[p * 8 + 1 : p * 8 + 8] AS v FROM kept, range(8) AS t(p))",
        "c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < 16)",
    ]
    far = " + ".join(f"(q.v[{i}] - c.v[{i}]) * (q.v[{i}] - c.v[{i}])" for i in range(1, 9))
    means = ", ".join(down(f"sum(v[{i}])::BIGINT", "count(*)") for i in range(1, 9))
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT q.vec_id, q.p, q.v, c.e, {far} AS d FROM parts q JOIN c{r} c ON q.p = c.p QUALIFY row_number() OVER (PARTITION BY q.vec_id, q.p ORDER BY d, c.e) = 1)")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT p, e, [{means}] AS v FROM a{r} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT k.vec_id, s.code, s.error, sum(s.error) OVER (PARTITION BY k.label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM kept k JOIN (SELECT vec_id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id) s ON s.vec_id = k.vec_id"""


OP11_SQL = _lloyd_sql()
