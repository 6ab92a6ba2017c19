"""Exact dedup against a history, by a minimal perfect hash.

The distinct digests of the history are split by their leading bits into
buckets of bounded size, and each bucket gets a minimal perfect hash
(hash, displace and compress: Belazzougui, Botelho, Dietzfelbinger 2009).
A slot holds the full digest, the locator of the row that wins and the number
of rows.  A lookup computes one slot and compares all bytes of the digest, so
a digest that is not in the history can never be taken for one that is.

Rows are reduced to one row per distinct digest before any of them meets the
index, so a text that makes up a third of the rows costs one lookup.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.llm.common import ascii_lower, id_remainder, stored, table

DIGEST_BYTES = 32
#: Distinct digests that a bucket of the index holds on average.
BUCKET_KEYS = 2048
#: Stands for the winner of a group in which no row has an id.
NO_ID = -(1 << 63)
_SEEDS = 64


def with_digest(df: DataFrame, text: str = "text", to: str = "digest") -> DataFrame:
    """Add the SHA-256 (32 bytes) of the text, A-Z lower-cased; null counts as empty."""
    return df.withColumn(to, F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)))


def bucket_of(digest: Column, buckets: int) -> Column:
    """The bucket by the digest's first 28 bits; ``buckets`` is at most 2**28."""
    return (F.conv(F.substring(F.hex(digest), 1, 7), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def _words(digests: np.ndarray, seed: int) -> np.ndarray:
    """Four 64-bit words of each digest, mixed with the seed (words are already uniform)."""
    words = digests.view("<u8").reshape(-1, 4).copy()
    if seed:
        words ^= words >> np.uint64(31)
        words *= np.uint64(2 * seed * 0x9E3779B97F4A7C15 + 1 & 0xFFFFFFFFFFFFFFFF)
        words ^= words >> np.uint64(29)
    return words


def _parts(digests: np.ndarray, seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = _words(digests, seed)
    groups = max(1, n // 4)
    return (w[:, 1] % np.uint64(groups)).astype(np.int64), (w[:, 2] % np.uint64(n)).astype(np.int64), (w[:, 3] % np.uint64(n)).astype(np.int64)


def build_slots(digests: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacement of each group, slot of each key) for distinct digests.

    ``digests`` is an (n, 32) array of bytes.  Groups of keys are placed from
    the largest to the smallest, each at the first displacement where all its
    keys fall on free slots; n keys fill exactly n slots.
    """
    n = len(digests)
    for seed in range(_SEEDS):
        group, f1, f2 = _parts(digests, seed, n)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(max(1, n // 4) + 1))
        sizes = np.diff(starts)
        free = np.ones(2 * n, dtype=bool)  # twice over, so that a shift is a slice
        moves, slots = np.zeros(len(sizes), dtype=np.int32), np.zeros(n, dtype=np.int64)
        for g in np.argsort(-sizes, kind="stable"):
            if not sizes[g]:
                break
            keys = order[starts[g] : starts[g + 1]]
            for turn in range(32):
                at = (f1[keys] + turn * f2[keys]) % n
                if len(np.unique(at)) < len(at):
                    continue
                fits = free[at[0] : at[0] + n]
                for a in at[1:]:
                    fits = fits & free[a : a + n]
                shift = int(fits.argmax())
                if fits[shift]:
                    slot = (at + shift) % n
                    free[slot] = free[slot + n] = False
                    moves[g], slots[keys] = turn * n + shift, slot
                    break
            else:
                break
        else:
            return seed, moves, slots
        if not sizes[g]:
            return seed, moves, slots
    raise ValueError(f"no perfect hash for {n} digests; are they distinct?")


def slot_of(digests: np.ndarray, n: int, seed: int, moves: np.ndarray) -> np.ndarray:
    """The one slot where each digest would be, member or not."""
    group, f1, f2 = _parts(digests, seed, n)
    return (f1 + (moves[group] // n) * f2 + moves[group] % n) % n


def _stack(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, DIGEST_BYTES)


INDEX_SCHEMA = "bucket int, n int, seed int, moves binary, digests binary, winners binary, counts binary"


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket from ``history`` (digest binary, winner long, n long), digests distinct."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = _stack(pdf.digest)
        seed, moves, slots = build_slots(digests)
        at = np.argsort(slots)
        return pd.DataFrame({
            "bucket": [int(pdf.bucket.iloc[0])], "n": [len(pdf)], "seed": [seed], "moves": [moves.tobytes()],
            "digests": [digests[at].tobytes()], "winners": [pdf.winner.to_numpy("int64")[at].tobytes()],
            "counts": [pdf.n.to_numpy("int64")[at].tobytes()],
        })

    return history.withColumn("bucket", bucket_of(F.col("digest"), buckets)).groupBy("bucket").applyInPandas(build, INDEX_SCHEMA)


def merge(index: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """Look the incoming digests up and return every group: digest, winner, n, known.

    ``incoming`` has one row per distinct digest (digest, winner, n).  Members
    join the group of their slot, whose winner is the larger of both; the
    others form groups of their own.  ``known`` tells which had a slot.
    """

    def look(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        out = []
        rest = np.ones(len(new), dtype=bool)
        if len(old):
            row = old.iloc[0]
            n = int(row.n)
            held = np.frombuffer(row.digests, dtype=np.uint8).reshape(n, DIGEST_BYTES)
            winners, counts = (np.frombuffer(row[c], dtype=np.int64).copy() for c in ("winners", "counts"))
            if len(new):
                digests = _stack(new.digest)
                slots = slot_of(digests, n, int(row.seed), np.frombuffer(row.moves, dtype=np.int32))
                member = (held[slots] == digests).all(axis=1)
                np.maximum.at(winners, slots[member], new.winner.to_numpy("int64")[member])
                np.add.at(counts, slots[member], new.n.to_numpy("int64")[member])
                rest = ~member
            out.append(pd.DataFrame({"digest": [x.tobytes() for x in held], "winner": winners, "n": counts, "known": True}))
        if rest.any():
            out.append(new.loc[rest, ["digest", "winner", "n"]].assign(known=False))
        return pd.concat(out)

    incoming = incoming.withColumn("bucket", bucket_of(F.col("digest"), buckets))
    return incoming.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(look, "digest binary, winner long, n long, known boolean")


def exact_groups(keyed: DataFrame, is_history: Column) -> DataFrame:
    """Groups of equal digests over ``keyed`` (doc_id, digest): digest, winner, n, known.

    ``is_history`` splits the rows into those already indexed and those that
    arrive.  An empty side, or an empty table, gives the groups of the other.
    """
    buckets = min(1 << 28, 1 + keyed.count() // (2 * BUCKET_KEYS))
    per_digest = lambda rows: rows.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("winner"), F.count("*").alias("n"))
    index = build_index(per_digest(keyed.where(is_history)), buckets)
    return merge(index, per_digest(keyed.where(~is_history)), buckets)


def exact_dedup(docs: DataFrame, history_parts: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts (A-Z lower-cased) form a group and the largest doc_id stays.
    The documents whose crc32(doc_id) is divisible by ``history_parts`` play
    the history that was indexed before the others came.

    Null texts count as empty ones; texts of any length are read whole.  Rows
    that repeat a doc_id count each, and all rows of the winning doc_id are
    kept.  Rows with a null doc_id never win against a row that has one; a
    group without any id keeps all its rows, with keep_id null.  Other columns
    are ignored, whatever their names.
    """
    keyed = stored(with_digest(docs.select("doc_id", "text")).select("doc_id", "digest"), "exact-digests")
    groups = stored(exact_groups(keyed, id_remainder(F.col("doc_id"), history_parts) == 0).select("digest", F.expr(f"nullif(winner, {NO_ID + 1}L - 1)").alias("winner"), "n"), "exact-groups")
    return keyed.join(groups, "digest").select(
        "doc_id", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
