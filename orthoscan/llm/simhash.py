"""SimHash near-dedup by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight bytes in eight positions.  Two fingerprints
that differ in at most three bits differ in at most three positions, so they
share at least five: a pair is a candidate only if the tally of its shared
positional bytes reaches five, and is then verified bit by bit.

Single positional bytes would post one fingerprint in 256 under each entry, so
the index posts sets of four positional bytes, all 70 of them, at any size: a
pair that shares five bytes or more shares at least five of these sets, one
that shares four bytes shares one.  The sets that a pair shares are counted
from the postings; pairs below the guaranteed count are dropped, the others are
verified bit by bit.

Copies are folded first: the index holds distinct fingerprints.  Entries of
up to SMALL_ENTRY fingerprints are joined and counted pair by pair.  A pair
that meets in a larger one needs no count: such an entry yields a spanning
forest of all its links, and those over FOREST_ENTRY are first split by a fifth
position, then by the bits that may differ.  So the rows stay linear in the
entries, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.llm.common import stored, table, text_slices
from orthoscan.llm.components import connected_components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
POSITIONS, SHARED = 8, 5
QUADRUPLES = [*combinations(range(8), 4)]
QUINTUPLES = [*combinations(range(8), 5)]
#: Quadruples that two fingerprints with SHARED equal positions share at least.
MIN_COUNT = comb(SHARED, 4)
SMALL_ENTRY, FOREST_ENTRY = 32, 8192
_BLOCK = 255  # counts of this many bits fit a byte


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of words, repeats included; fewer words make one shingle, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both of them
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of ``hashes``; runs begin at ``starts`` and aren't empty.

    Eight bit counts at a time sit in the bytes of one word, summed in blocks
    short enough not to overflow.
    """
    sizes = np.diff(np.append(starts, len(hashes)))
    blocks = -(-sizes // _BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    at = np.repeat(starts - first * _BLOCK, blocks) + np.arange(blocks.sum()) * _BLOCK
    out = np.zeros(len(starts), dtype=np.uint64)
    ones = np.uint64(0x0101010101010101)
    for k in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(k)) & ones, at)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for j in range(8):
            out |= (2 * counts[:, j] > sizes).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for b in batches for x in text_slices(b, 1)):
        out = np.zeros(len(batch), dtype=np.uint64)
        rows, starts, hashes = [], [], []
        def flush() -> None:
            if rows:
                out[rows] = majority_bits(np.array(hashes, dtype=np.uint64), np.array(starts))
                for x in (rows, starts, hashes):
                    x.clear()
        for i, text in enumerate(batch.column(1)):
            if found := shingle_hashes(text.as_py()):
                rows.append(i)
                starts.append(len(hashes))
                hashes += found
            if len(hashes) > 500_000:
                flush()
        flush()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _entry(positions: tuple[int, ...], number: int) -> Column:
    """The index entry of a fingerprint: the bytes at ``positions``, tagged with the set's number."""
    part = lambda k, p: F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")), 8 * k)
    return reduce(Column.bitwiseOR, [part(k, p) for k, p in enumerate(positions)], F.lit(number << 40).cast("long"))


def postings(nodes: DataFrame, family: list[tuple[int, ...]]) -> DataFrame:
    """entry, fp: each fingerprint under each set of positions of the family."""
    return nodes.select("fp", F.explode(F.array(*[_entry(p, n) for n, p in enumerate(family)])).alias("entry"))


def spanning_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects exactly what links of at most ``max_bits`` connect."""
    rest, a, b = fps.copy(), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue[-1]) <= max_bits
            at = queue.pop()
            found = rest[near]
            if len(found):
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = spanning_links(np.unique(pdf.fp.to_numpy("int64")).view(np.uint64))
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _sized(posted: DataFrame, name: str) -> DataFrame:
    """Postings of the entries that hold more than one fingerprint, with the entry's size."""
    sizes = stored(posted.groupBy("entry").agg(F.count("*").alias("size")).where("size > 1"), f"{name}-sizes")
    return stored(posted.join(sizes.hint("merge"), "entry"), name)  # as many entries as there are near pairs: never broadcast


def _wildcards(fp: Column, shared: int) -> Column:
    """Entries in which any two fingerprints of the same quintuple differ in at most three bits: one per three of the other bits."""
    free = [b for p in range(POSITIONS) if p not in QUINTUPLES[shared] for b in range(8 * p, 8 * p + 8)]
    masks = [sum(1 << b for b in bits) for bits in combinations(free, MAX_BITS)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.lit(signed), lambda m: F.struct(m.alias("mask"), fp.bitwiseAND(F.bitwise_not(m)).alias("rest")))


def counted_pairs(small: DataFrame) -> DataFrame:
    """a, b: the pairs that share MIN_COUNT entries or more, counted from the postings of ``small`` (entry, fp)."""
    met = small.alias("l").join(small.alias("r"), (F.col("l.entry") == F.col("r.entry")) & (F.col("l.fp") < F.col("r.fp")))
    return met.groupBy(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= MIN_COUNT).select("a", "b")


def link_pairs(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all ``nodes`` (fp, distinct) at most three bits apart."""
    sized = _sized(postings(nodes, QUADRUPLES), "simhash-index")
    pairs = counted_pairs(sized.where(F.col("size") <= SMALL_ENTRY).select("entry", "fp"))
    links = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    forest = lambda df: df.where(f"size > {SMALL_ENTRY} AND size <= {FOREST_ENTRY}").groupBy("entry").applyInPandas(_forest, "a long, b long")
    links = links.unionByName(forest(sized))
    if (sized.agg(F.max("size")).first()[0] or 0) > FOREST_ENTRY:
        crowded = sized.where(f"size > {FOREST_ENTRY}").select("fp").distinct()
        finer = _sized(postings(crowded, QUINTUPLES), "simhash-finer")
        links = links.unionByName(forest(finer.withColumn("size", F.greatest("size", F.lit(SMALL_ENTRY + 1)))))
        full = finer.where(F.col("size") > FOREST_ENTRY).withColumn("number", F.shiftrightunsigned("entry", 40))
        for (n,) in full.select("number").distinct().collect():  # 56 at most
            star = full.where(F.col("number") == n).select("fp", F.inline(_wildcards(F.col("fp"), n)))
            least = star.groupBy("mask", "rest").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
            links = links.unionByName(star.join(stored(least, "simhash-wild"), ["mask", "rest"]).where("fp > least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct())
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    Texts are read whole, A-Z lower-cased, cut at [\\x20\\x09-\\x0D] into words
    and these into shingles of three, repeats included.  A bit of the
    fingerprint is 1 if it is in over half the shingles' XXH64 (seed 42).
    Fewer words make one shingle; null, empty and blank texts have the
    fingerprint zero, which links like any other.  Fingerprints at most three
    bits apart are linked; component_id is the smallest doc_id reachable.

    Repeated rows and doc_ids give a row each.  A null doc_id is never a
    component_id unless its component has no other.  Extra columns are ignored.
    """
    fps = stored(fingerprints(docs), "simhash-fps")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = connected_components(link_pairs(nodes.select("fp")))
    linked = stored(nodes.join(roots.withColumnRenamed("node", "fp"), "fp"), "simhash-linked")
    least = stored(linked.groupBy("root").agg(F.min("first_id").alias("least_id")), "simhash-least")
    held = linked.join(least, "root").select("fp", "least_id")
    component = stored(nodes.join(held, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "simhash-components")
    return fps.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    All columns pass through.  Rows that share the staying doc_id all stay, and
    so do rows without a doc_id in components without any.

    The staying ids are about as many as the documents, so the join is a merge
    at every size; a table bucketed by doc_id saves it the shuffle of the texts.
    """
    staying = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("staying")).distinct()
    staying = stored(staying, "simhash-staying")
    return docs.join(staying.hint("merge"), docs["doc_id"].eqNullSafe(staying["staying"]), "left_semi")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
