"""Benchmark decontamination by template canonicalisation.

Texts become sequences of lower-cased tokens in which numbers, names and units
are typed placeholders, runs of one type being one placeholder.  Windows of
these sequences are hashed and joined with the windows of the benchmark.  A
document holds an item if enough of the item's windows follow each other in it
and the placeholders are filled consistently: where the item repeats a value,
the document repeats its own.  So questions that were given new numbers and
names are caught as well as verbatim copies.

What documents and items have in common is looked up by an item's rarest
windows, so many that no document that holds enough of them is missed, and by
runs of MIN_RUN tokens; only the lines found so are compared window by window.
A phrase that many documents and many items share isn't looked up where the
item has enough else.

Two sequences are made of every text: one with numbers and units replaced,
which doesn't depend on capitals, and one with names (capitalised tokens)
replaced too.  Items that have no window with enough words in either are
compared whole, as they are, token by token.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoscan.llm.common import arrow_rows, freed, giving_back, stored, table, text_slices

#: Tokens of a window; items of fewer tokens, from MIN_LITERAL on, are one window.
WINDOW = 8
#: A window counts if so many of its tokens are words.
MIN_LITERAL = 5
#: The share of an item's windows that must be found in line.
MIN_SHARE = 0.2
#: Or so many of its tokens in a row, whatever their share.
MIN_RUN = 50
#: Windows of the benchmark that are broadcast (8 bytes each); beyond, both sides are shuffled.
BROADCAST_WINDOWS = 4_000_000
#: Words after a number that count as its unit (fixed values).
UNITS = (
    "g kg mg lb lbs oz ounce ounces gram grams kilogram kilograms pound pounds ton tons tonne tonnes "
    "m mm cm km mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "s ms min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "l ml liter liters litre litres gallon gallons dollar dollars euro euros cent cents percent degree degrees mph kmh hz khz mhz w kw v"
).split()
NUMBER, UNIT, NAME = 1, 2, 3
LITERAL, TEMPLATE, EXACT = 0, 1, 2
_CHUNK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TYPE_CODE = _rng.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=np.uint8)
_DIGIT[48:58] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _STEP, dtype=np.uint64), dtype=np.uint64)


def _token_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), dtype=np.uint8)
    return int((_BYTE_CODE[b] * _powers(len(b))).sum(dtype=np.uint64))


_UNIT_CODES = np.sort(np.array([_token_hash(u) for u in UNITS], dtype=np.uint64))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, type and text number of every token; capitals are of type NAME."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    inside = _TOKEN[data]
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int64)
    lengths = ends - starts
    own = data[inside]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(own)) - np.repeat(first, lengths)
    codes = np.add.reduceat(_BYTE_CODE[_LOWER[own]] * _powers(int(lengths.max()))[place], first)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    number = np.maximum.reduceat(_DIGIT[own], first) == 1
    follows = np.concatenate([[False], number[:-1] & (text[1:] == text[:-1])])
    head, second = own[first], own[np.minimum(first + 1, len(own) - 1)]
    capital = ((head >= 65) & (head < 91)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (lengths > 1))
    kind = np.where(number, NUMBER, np.where(follows & np.isin(codes, _UNIT_CODES), UNIT, np.where(capital, NAME, 0))).astype(np.int8)
    return codes, kind, text


def _sequence(codes: np.ndarray, kind: np.ndarray, text: np.ndarray, sort: int) -> tuple[np.ndarray, ...]:
    """Canonical codes, values of placeholders (0 for words) and text numbers, runs of a type being one; EXACT replaces nothing."""
    kind = np.where((kind == NAME) & (sort == LITERAL) | (sort == EXACT), 0, kind)
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(keep)
    values = np.add.reduceat(codes, at) if len(at) else codes
    kind = kind[at]
    return np.where(kind > 0, _TYPE_CODE[kind], values), np.where(kind > 0, values, np.uint64(0)), text[at]


def _mixed(codes: np.ndarray, offsets: Iterable[int], n: int, seed: int) -> np.ndarray:
    """A hash at each of the first ``n`` places, of the codes at these offsets from it."""
    hashes = np.full(n, np.uint64(seed), dtype=np.uint64)
    for j in offsets:
        hashes = (hashes ^ codes[j : j + n]) * _STEP
        hashes ^= hashes >> np.uint64(29)
    return hashes


def _windows(codes: np.ndarray, values: np.ndarray, text: np.ndarray, size: int, sort: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``size`` tokens with enough words, and each start's place in its text.

    Windows of more than WINDOW tokens are hashed from the hashes of WINDOW tokens that cover them.
    """
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.concatenate([[0], np.cumsum(values == 0)])
    at = np.flatnonzero((text[:n] == text[size - 1 :]) & (words[size:] - words[:n] >= MIN_LITERAL))
    part = min(size, WINDOW)
    hashes = _mixed(codes, range(part), len(codes) - part + 1, size * 3 + sort)
    if size > part:
        hashes = _mixed(hashes, [*range(0, size - part, part), size - part], n, size * 3 + sort)
    begin = np.searchsorted(text, text[at], side="left")
    return at, hashes[at], at - begin


SCHEMA = "id long, text_key long, sort int, size int, pos int, tokens int, hash long, slots array<long>"
_ARROW = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("sort", pa.int32()), ("size", pa.int32()), ("pos", pa.int32()), ("tokens", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.int64()))])


def template_windows(rows: DataFrame, wanted_sizes: list[tuple[int, int]], only: np.ndarray | None = None, whole_short: bool = False) -> DataFrame:
    """The windows of ``rows`` (id, text_key, text), as SCHEMA; ``only`` keeps those with a hash among these (sorted).

    With ``whole_short`` a text of fewer than WINDOW tokens gives one window of
    all of them, else every text gives the windows of all ``wanted_sizes``
    (sort, size).  Those of more than WINDOW tokens have no slots.
    """
    wanted = rows.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value if wanted else None
        if known is not None:
            sieve = np.zeros(1 << 22, dtype=bool)
            sieve[known & np.uint64((1 << 22) - 1)] = True
        for batch in (x for b in giving_back(batches) for x in text_slices(b, 2)):
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            ids, keys = np.array(batch.column(0)), np.array(batch.column(1))
            lo = 0
            while lo < len(texts):
                hi, room = lo, _CHUNK
                while hi < len(texts) and (hi == lo or room >= len(texts[hi])):
                    room -= len(texts[hi])
                    hi += 1
                tokens = _tokens(texts[lo:hi])
                for sort in sorted({sort for sort, _ in wanted_sizes}):
                    codes, values, text = _sequence(*tokens, sort)
                    length = np.bincount(text, minlength=hi - lo)
                    for size in sorted(size for of, size in wanted_sizes if of == sort):
                        at, hashes, pos = _windows(codes, values, text, size, sort)
                        if whole_short:
                            ok = np.full(len(at), True) if size == WINDOW else length[text[at]] == size
                            at, hashes, pos = at[ok], hashes[ok], pos[ok]
                        if known is not None:
                            maybe = np.flatnonzero(sieve[hashes & np.uint64((1 << 22) - 1)])
                            there = np.searchsorted(known, hashes[maybe])
                            hit = maybe[(there < len(known)) & (known[np.minimum(there, len(known) - 1)] == hashes[maybe])] if len(known) else maybe[:0]
                            at, hashes, pos = at[hit], hashes[hit], pos[hit]
                        if not len(at):
                            continue
                        width = size if size <= WINDOW else 0
                        slots = values[at[:, None] + np.arange(width)].view(np.int64)
                        flat = pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * width).astype(np.int32)), pa.array(slots.reshape(-1)))
                        whole = np.full(len(at), 0, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][text[at]]), pa.array(keys[lo:hi][text[at]]), pa.array(whole + sort), pa.array(whole + size), pa.array(pos.astype(np.int32)), pa.array(length[text[at]].astype(np.int32)), pa.array(hashes.view(np.int64)), flat], schema=_ARROW)
                lo = hi

    return rows.mapInArrow(freed(cut), SCHEMA)


def _rows(df: DataFrame, key: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


#: Stands for a null id.
NO_ID = -(1 << 63)


def _item_windows(benchmark: DataFrame, sizes: list[tuple[int, int]], whole_short: bool) -> DataFrame:
    """The windows of the items, repeated rows once: item_id, item_key, sort, size, item_pos, hash, item_slots."""
    windows = template_windows(_rows(benchmark, "item_id").distinct(), sizes, whole_short=whole_short).drop("tokens")
    return stored(windows.withColumnsRenamed({"id": "item_id", "text_key": "item_key", "pos": "item_pos", "slots": "item_slots"}), "benchmark-all-windows")


def _longest_run(places: Column, size: Column) -> Column:
    """Tokens of the longest stretch that windows of ``size`` tokens at ``places`` cover."""
    none = F.struct(F.lit(-1).alias("begin"), F.lit(-1).alias("end"), F.lit(0).alias("best"))

    def step(acc: Column, at: Column) -> Column:
        begin = F.when(at <= acc["end"], acc["begin"]).otherwise(at)
        return F.struct(begin.alias("begin"), (at + size).alias("end"), F.greatest(acc["best"], at + size - begin).alias("best"))

    return F.aggregate(F.sort_array(places), none, step)["best"]


def lookups(asked: DataFrame, held: DataFrame, min_share: float) -> DataFrame:
    """The windows of ``asked`` by which items are looked up: item_id, item_key, sort, size, item_pos, hash.

    A document that holds ``need`` of an item's n windows holds one of any
    n - need + 1, so the rarest in ``held`` of so many will do.  Those that no
    document has are left out.
    """
    key = ["hash", "sort", "size"]
    places = asked.select("item_id", "item_key", *key, "item_pos")
    texts = held.groupBy(*key).agg(F.count("*").alias("texts"))
    item = Window.partitionBy("item_id", "item_key", "sort")
    ranked = places.join(texts, key, "left").withColumns({"rank": F.row_number().over(item.orderBy(F.coalesce("texts", F.lit(0)), "item_pos")), "of": F.count("*").over(item)})
    need = F.when(F.col("sort") == EXACT, F.col("of")).otherwise(F.greatest(F.ceil(F.col("of") * min_share - 1e-9), F.lit(1)))
    return ranked.where((F.col("rank") <= F.col("of") - need + 1) & F.col("texts").isNotNull()).select(*places.columns)


def candidate_lines(asked: DataFrame, runs: DataFrame, held: DataFrame, min_share: float) -> DataFrame:
    """Where an item may lie in a document: id, text_key, item_id, item_key, sort, shift.

    ``asked`` are the items' windows, ``runs`` their windows of MIN_RUN tokens,
    ``held`` those of either that documents have.
    """
    wanted = lookups(asked, held, min_share).unionByName(runs.select("item_id", "item_key", "hash", "sort", "size", "item_pos"))
    found = held.select("id", "text_key", "hash", "sort", "size", "pos").join(wanted, ["hash", "sort", "size"])
    return found.select("id", "text_key", "item_id", "item_key", "sort", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """id, text_key, item_id, sort, n_windows, share of each benchmark item that a document holds.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; both are read
    whole.  ``share`` is the part of the item's windows found in line; it must
    reach ``min_share``, or MIN_RUN tokens (a placeholder is one) must follow
    each other, for which windows with the item's own values always count.  An
    item without any window of enough words is held if all its tokens, as they
    are, follow each other in the document.  Null and empty texts hold nothing,
    and so do empty tables; items of fewer than MIN_LITERAL tokens can't be
    told from chance and are never held.  Repeated
    items count each; repeated documents give the same row once.  ``id`` is
    NO_ID for a null doc_id.
    """
    sizes = [(sort, size) for sort in (LITERAL, TEMPLATE, EXACT) for size in range(MIN_LITERAL, WINDOW + 1)]
    with arrow_rows(docs.sparkSession):
        every, runs = (_item_windows(benchmark, *of) for of in ((sizes, True), ([(LITERAL, MIN_RUN), (TEMPLATE, MIN_RUN)], False)))
        usual = every.where(F.col("sort") != EXACT)
        others = every.where(F.col("sort") == EXACT).join(usual.select("item_key").distinct(), "item_key", "left_anti")
        asked = stored(usual.unionByName(others), "benchmark-windows")
        both = asked.unionByName(runs)
        used = sorted(tuple(r) for r in both.select("sort", "size").distinct().collect())  # fourteen at most
        distinct = both.select("hash").distinct()
        few = distinct.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
        only = np.sort(distinct.toArrow().column(0).to_numpy().view(np.uint64)) if few else None
        held = template_windows(_rows(docs, "doc_id"), used or [(LITERAL, WINDOW)], only).drop("tokens")
        held = stored(held if few else held.join(distinct, "hash", "left_semi"), "template-hits")
    lines = stored(candidate_lines(asked, runs, held, min_share), "template-lines")
    compared = lines.join(asked, ["item_id", "item_key", "sort"]).withColumn("pos", F.col("item_pos") + F.col("shift"))
    met = stored(held.join(compared, ["id", "text_key", "sort", "size", "hash", "pos"]).distinct(), "template-met")
    line = ["id", "text_key", "item_id", "item_key", "sort", "shift"]
    slots = met.select(*line, F.explode(F.arrays_zip(F.col("slots").alias("own"), F.col("item_slots").alias("asked"))).alias("s")).where("s.asked <> 0").select(*line, "s.own", "s.asked").distinct()
    odd = slots.groupBy(*line, "asked").agg(F.count("*").alias("n")).where("n > 1").select(*line).distinct()  # new values may coincide: own isn't asked for
    marked = met.join(odd.withColumn("odd", F.lit(True)), line, "left")
    fits, same = F.col("odd").isNull(), F.col("slots") == F.col("item_slots")
    in_line = marked.groupBy(*line, "size").agg(F.countDistinct(F.when(fits, F.col("item_pos"))).alias("n_windows"), F.collect_set(F.when(fits | same, F.col("item_pos"))).alias("places"))  # an item's places at most
    of_item = asked.groupBy("item_id", "item_key", "sort").agg(F.countDistinct("item_pos").alias("of"))
    held_share = (F.col("n_windows") > 0) & (F.col("share") >= F.when(F.col("sort") == EXACT, 1.0).otherwise(min_share))
    run = _longest_run(F.col("places"), F.col("size"))
    shares = in_line.join(of_item, ["item_id", "item_key", "sort"]).withColumn("n_windows", F.when(run >= MIN_RUN, F.greatest("n_windows", F.size("places"))).otherwise(F.col("n_windows")).cast("long"))
    shares = shares.withColumn("share", F.col("n_windows") / F.col("of")).where(held_share | (F.col("sort") != EXACT) & (run >= MIN_RUN))
    best = shares.groupBy("id", "text_key", "item_id").agg(F.max(F.struct("share", "n_windows", (F.col("sort") != TEMPLATE).cast("int").alias("literal"))).alias("b"))
    return best.select("id", "text_key", "item_id", F.when(F.col("b.literal") == 1, "literal").otherwise("template").alias("sort"), F.col("b.n_windows").alias("n_windows"), F.col("b.share").alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns pass through, whatever their names."""
    gone = stored(contaminated(docs, benchmark, min_share).select("id", "text_key").distinct(), "contaminated")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == gone["id"]) & (F.xxhash64(text) == gone["text_key"])
    return docs.join(gone, same, "left_anti")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds; clean documents have none."""
    hits = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.groupBy(F.expr(f"nullif(id, {NO_ID + 1}L - 1)").alias("doc_id"), "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("share").alias("share"))
