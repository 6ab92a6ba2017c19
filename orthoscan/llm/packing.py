"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``CAPACITY`` tokens.  Only how many pieces
there are of each length matters to a packing, and there are at most
``CAPACITY`` lengths, whatever the corpus: the plan is made from that
histogram.  For the longest length left, an index of the single, pair and
triple sums of the available lengths is asked for what fills the gap exactly;
as many sequences of that combination are taken as the counts allow.  Gaps
that nothing fills take the longest length that fits, and so on.

The plan is a short list of (lengths, how many sequences).  Pieces find their
place in it by their rank within their length, which is a count over the
partitions before plus a rank in the own partition, so a length that a third
of all pieces have needs no common task.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoscan.llm.common import arrow_rows, freed, giving_back, stored, table, text_slices, texts_of

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct stems whose ids a task keeps, some 40 MB; beyond, it starts anew.
CACHED_STEMS = 150_000
#: Lower-case letters of ASCII and Latin-1: no normalisation changes them.
_LETTERS = "abcdefghijklmnopqrstuvwxyzß" + "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100)]))
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of such letters, in either case, with or without marks after them.
_PLAIN = f"^[{_LETTERS.replace('ß', '').replace('ÿ', '')}{_LETTERS.replace('ß', '').replace('ÿ', '').upper()}ßÿ]+[{re.escape(_MARKS)}]*$"
#: Bytes of text that are encoded at a time; arrays of some 40 times as much are made of them.
_SLICE = 1 << 19


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordEncoder:
    """Ids of words; what was encoded once is kept for the next text.

    The tokenizer's rules never reach across ASCII white space, it lower-cases,
    and it parts marks from the letters before them.  So texts are cut into
    words, and words of plain letters into a stem and its marks; each distinct
    stem is merged once by the tokenizer's own model.  All other words are
    encoded by the whole tokenizer, as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.ids, self.size = np.zeros(1 << 16, dtype="<u4"), 0
        self.ends = np.zeros(1 << 16, dtype=np.int64)  # of each unit in ids; unit 0 is empty

    def _add(self, units: list[str], ids: array, lengths: array) -> None:
        known = len(self.number)
        self.number.update(zip(units, range(known, known + len(units)), strict=True))
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while known + len(units) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.size : self.size + len(ids)] = ids
        self.ends[known : known + len(units)] = self.size + np.cumsum(lengths)
        self.size += len(ids)

    def _numbers(self, units: pa.Array, plain: bool) -> np.ndarray:
        """The number of each unit, a stem of plain letters or any other string."""
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = [*map(self.number.get, distinct)]
        if None in found:
            new = [u for u, n in zip(distinct, found, strict=True) if n is None]
            ids, lengths = array("I"), array("q")
            if plain:
                for own in map(self.merge, [u if u.isascii() else u.translate(self.alphabet) for u in new]):
                    ids.extend([t.id for t in own])
                    lengths.append(len(own))
            else:
                for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False):
                    ids.extend(e.ids)
                    lengths.append(len(e.ids))
            self._add(new, ids, lengths)
            found = [*map(self.number.__getitem__, distinct)]
        return np.array(found, dtype=np.int64)[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings, nulls empty), END_ID after each, and how many each has."""
        if len(self.number) > CACHED_STEMS:
            self.clear()
        lists = pc.ascii_split_whitespace(texts_of(texts))
        of_text = np.diff(lists.offsets.to_numpy())
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary
        plain = pc.match_substring_regex(distinct, _PLAIN)
        at, others = np.flatnonzero(plain.to_numpy(zero_copy_only=False)), np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        low = pc.utf8_lower(distinct.take(pa.array(at)))
        stems = pc.ascii_rtrim(low, characters=_MARKS)
        tails = pc.utf8_ltrim(low, characters=_LETTERS)
        stem, tail = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        stem[at], tail[at] = self._numbers(stems, True), self._numbers(tails, False)
        stem[others] = self._numbers(distinct.take(pa.array(others)), False)
        units = np.stack([stem, tail], axis=1)[words.indices.to_numpy()].reshape(-1)
        starts = self.ends[units - 1] * (units > 0)
        lengths = self.ends[units] - starts
        first = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.ids[np.repeat(starts - first[:-1], lengths) + np.arange(first[-1])]
        ends = first[2 * np.cumsum(of_text)]
        return np.insert(flat, ends, END_ID), np.diff(ends, prepend=0) + 1


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: the piece's place among those of its length in its partition.

    ``part`` and ``nth`` hold for one run only; write the result before use.
    """
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = WordEncoder(path)  # goes with the task: a worker that is idle holds no stems
        part, seen = TaskContext.get().partitionId(), {}
        for batch in (x for b in giving_back(batches) for x in text_slices(b, 1, _SLICE)):
            rows, begin = [], 0
            ids, lengths = encoder.encode(batch.column(1))
            data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            for doc_id, own in zip(batch.column(0).to_pylist(), lengths.tolist(), strict=True):
                for n, at in enumerate(range(0, own, capacity)):
                    length = min(capacity, own - at)
                    nth = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc_id, n, at, length, zlib.crc32(data[4 * (begin + at) : 4 * (begin + at + length)]), part, nth))
                begin += own
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


class Complements:
    """Which available lengths, pairs and triples of them, sum to a gap.

    The index holds a bit for each sum of one, two and three lengths.  A sum is
    in it if lengths that are there give it; whether there are enough of a
    length used twice or thrice is checked when a combination is drawn.
    """

    def __init__(self, counts: np.ndarray):
        self.counts, self.capacity = counts, len(counts) - 1
        self.bits = sum(1 << int(i) for i in np.nonzero(counts > 0)[0])
        self._sums()

    def _sums(self) -> None:
        """Index the pair and triple sums of the lengths that are there now."""
        full = (1 << (self.capacity + 1)) - 1
        self.pairs = self.triples = self.gone = 0
        there = np.nonzero(self.counts > 0)[0].tolist()
        for a in there:
            self.pairs |= (self.bits << a) & full
        for a in there:
            self.triples |= (self.pairs << a) & full

    def take(self, lengths: list[int], n: int) -> None:
        for x in lengths:
            self.counts[x] -= n
            if not self.counts[x] and self.bits >> x & 1:
                self.bits &= ~(1 << x)
                self.gone += 1
        if self.gone >= 32:  # sums of lengths that are gone cost time, nothing else
            self._sums()

    def pair(self, gap: int) -> list[int] | None:
        """The pair that sums to the gap with the longest member."""
        if gap < 2 or not self.pairs >> gap & 1:
            return None
        half = gap // 2
        ok = (self.counts[1 : half + 1] > 0) & (self.counts[gap - 1 : gap - half - 1 : -1] > 0)
        if gap % 2 == 0:
            ok[-1] = self.counts[half] >= 2
        return [gap - 1 - i, 1 + i] if ok[i := int(ok.argmax())] else None

    def triple(self, gap: int) -> list[int] | None:
        """The triple that sums to the gap with the longest member."""
        if gap < 3 or not self.triples >> gap & 1:
            return None
        for c in np.nonzero(self.counts[: gap - 1] > 0)[0][::-1].tolist():
            if 3 * c < gap:
                return None
            if self.pairs >> (gap - c) & 1:
                self.counts[c] -= 1
                two = self.pair(gap - c)
                self.counts[c] += 1
                if two:
                    return [c, *two]
        return None

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that fill the gap exactly."""
        return [gap] if self.counts[gap] > 0 else self.pair(gap) or self.triple(gap)

    def longest(self, gap: int) -> int:
        """The longest available length of at most ``gap``, or 0."""
        return (self.bits & ((1 << (gap + 1)) - 1)).bit_length() - 1 if self.bits & ((1 << (gap + 1)) - 1) else 0


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, sequences) so that every piece of the histogram is in one sequence."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    index, plan = Complements(counts), []
    while head := index.longest(capacity):
        chosen = [head]
        index.take([head], 1)
        gap = capacity - head
        while gap:
            if found := index.exact(gap):
                index.take(found, 1)
                chosen += found
                break
            if not (fit := index.longest(gap)):
                break
            index.take([fit], 1)
            chosen.append(fit)
            gap -= fit
        again = min(int(index.counts[x]) // chosen.count(x) for x in set(chosen))
        for x in set(chosen):
            index.take([x], again * chosen.count(x))
        plan.append((chosen, 1 + again))
    return plan


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored ``pieces``."""
    spark = cut.sparkSession
    held = stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r[0]: r[1] for r in held.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    slots, first, used = [], 0, dict.fromkeys(histogram, 0)
    for lengths, n in plan_packing(histogram, capacity):
        at = 0
        for x in lengths:
            slots.append((x, used[x], used[x] + n, first - used[x], at))
            used[x] += n
            at += x
        first += n
    plan = spark.createDataFrame(slots, "length long, low long, high long, shift long, offset long") if slots else spark.createDataFrame([], "length long, low long, high long, shift long, offset long")
    runs = stored(plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "shift", "offset"))).alias("runs")), "packing-plan")  # as many slots as steps of the plan
    # lengths times partitions grow with the corpus: never broadcast
    ranked = cut.join(stored(before, "packing-before").hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    slot = F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]
    return ranked.join(F.broadcast(runs), "length").withColumn("slot", slot).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("slot.shift")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    Null and empty texts hold the end id only.  Texts are encoded whole and cut
    only where they exceed ``capacity``.  Rows that repeat a doc_id, or have
    none, are packed like any other.  Extra columns are ignored; an empty table
    gives no row.
    """
    with arrow_rows(docs.sparkSession):
        cut = stored(pieces(docs, path, capacity), "packing-pieces")
    return place(cut, capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
