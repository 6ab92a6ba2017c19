"""Removal of long repeated byte strings, by suffix arrays of shards.

A window is a string of LENGTH bytes.  What brings equal windows of different
documents together is an anchor: the least of a window's hashed substrings of
ANCHOR bytes, which depends on the window's bytes alone.  Windows that follow
each other with one anchor are a run, LENGTH + their number - 1 bytes, so a
document is a row per some 180 windows, and a run whose anchor is nowhere else
is done.

Runs of the very same bytes are counted, not compared: their windows all repeat.
One run of each kind is left, and those whose anchor has several kinds go to
shards by anchor.  A shard's runs are joined to one text, which gets a suffix
array by induced sorting and its permuted common prefixes
(``llm.suffix_array``); windows that share LENGTH bytes with a neighbour in the
array repeat.  Of a shard's runs only blocks go there whose core, the bytes that
all windows of a block share, is in several kinds of blocks; equal blocks are
counted first, like runs.

An anchor that more than CROWD kinds of runs share, as those at the borders of a
passage that a third of all documents hold, would fill a shard with them.  Its
runs are cut into shorter ones of at most 64, 8 and 1 windows, by the windows'
distance to the anchor, whose key is what all windows of that distance share;
then equal ones are counted and single ones dropped anew.  Nothing is left over:
a run of one window is its own key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.llm.common import arrow_rows, stored, table, text_slices
from orthoscan.llm.suffix_array import common_prefixes, suffix_array

LENGTH, ANCHOR = 400, 50
#: Kinds of runs with one anchor that a shard takes; and windows of a run at most, in each step for more.
CROWD, WIDTHS = 512, (64, 8, 1)
#: Windows of a block, by which a shard's runs are sorted out before they are compared.
BLOCK = 64
#: Bytes of a shard, about, and shards at least.
SHARD_BYTES, SHARDS = 1 << 20, 32
#: Window starts that are hashed at a time.
CHUNK = 1 << 20
#: Bits of the bitmap that keeps texts without candidates from being shuffled, and tasks that make it.
SIEVE_BITS, SIEVE_PARTS = 1 << 25, 8
#: Base of the rolling hash, odd.
BASE = 0x5851F42D4C957F2D

RUNS = "key long, kind binary, owner binary, start int, windows int, anchor int"


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, dtype=np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _substring_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each position on."""
    up, down = (p[: len(data)] for p in _powers(1 << int(len(data)).bit_length()))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(data * up)])
    h = (total[ANCHOR:] - total[:-ANCHOR]) * down[: len(data) - ANCHOR + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    before = np.minimum.accumulate(padded, axis=1).reshape(-1)
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, key) of the runs of texts that end at ``ends`` of ``data``; positions are in ``data``, the anchor's is from the start."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    h = _substring_hashes(data)
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
    anchor = (_least(ranked, LENGTH - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.append(0, ends[:-1])
    long = ends - begins >= LENGTH
    steps = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(steps, begins[long], 1)
    np.add.at(steps, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(steps)[: len(anchor)] > 0
    changes = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])]))
    start, stop = changes, np.append(changes[1:], len(anchor))
    start, stop = start[inside[changes]], stop[inside[changes]]
    return start, stop - start, anchor[start] - start, h[anchor[start]].view(np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, in one array, and where each value ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _kind(data: memoryview) -> bytes:
    return xxhash.xxh3_128_digest(data, seed=5)


def _pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(bytes, position of the first, ends of texts in them), so that every window is in one piece and pieces stay small."""
    lo = 0
    while lo < max(1, len(data) - LENGTH + 1):
        hi = min(len(data), lo + CHUNK + LENGTH - 1)
        inside = ends[(ends > lo) & (ends < hi)] - lo
        yield data[lo:hi], lo, np.append(inside, hi - lo)
        lo += CHUNK


def _owned(docs: DataFrame) -> DataFrame:
    """owner, a 128-bit digest of the text; and the text as bytes, null ones empty."""
    return docs.select(_owner(F.col("text")).alias("owner"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"))


def _owner(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def runs(docs: DataFrame) -> DataFrame:
    """A row for every run of every text: key, kind (128-bit digest of its bytes), owner, start, windows, anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in text_slices(b, 1)):
            all_data, all_ends = _bytes_of(batch.column(1))
            all_begins = np.append(0, all_ends[:-1])
            for data, lo, ends in _pieces(all_data, all_ends):
                start, windows, anchor, key = runs_of(data, ends)
                view = memoryview(np.ascontiguousarray(data))
                kinds = [_kind(view[s:e]) for s, e in zip(start.tolist(), (start + windows + LENGTH - 1).tolist(), strict=True)]
                of = np.searchsorted(all_ends, start + lo, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kinds, pa.binary()), batch.column(0).take(pa.array(of)), *[pa.array(x.astype(np.int32)) for x in (start + lo - all_begins[of], windows, anchor)]], ["key", "kind", "owner", "start", "windows", "anchor"])

    return _owned(docs.where(F.octet_length("text") >= LENGTH)).mapInArrow(cut, RUNS)


def _sieve(keys: DataFrame) -> np.ndarray:
    """Bitmap of fixed size of ``keys`` (owner)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE_BITS, dtype=bool)
        for batch in batches:
            bits[batch.column(0).to_numpy() & (SIEVE_BITS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(SIEVE_BITS // 8, dtype=np.uint8)
    for part in keys.select(F.xxhash64("owner")).coalesce(SIEVE_PARTS).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(part[0]), dtype=np.uint8)
    return out


def _maybe_among(keys: DataFrame):
    """A filter on owners: all of ``keys`` (owner) pass, and a few others; it saves a shuffle of their texts."""
    shared = keys.sparkSession.sparkContext.broadcast(_sieve(keys))

    @F.arrow_udf("boolean")
    def passes(hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy(zero_copy_only=False) & (SIEVE_BITS - 1)
        return pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return lambda owner: passes(F.xxhash64(owner))


def _shared_keys(kinds: DataFrame) -> DataFrame:
    """key, crowd: keys that several ``kinds`` (a row a key and kind) have."""
    return stored(kinds.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1").withColumnRenamed("key", "of_key"), "suffix-shared")  # written: the join then shuffles both sides itself, and a frequent key can be split


def _with_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (owner and the columns of a run) with the bytes of each; a text is sent once, whatever its copies."""
    maybe = _maybe_among(wanted)
    texts = _owned(docs).where(maybe(F.col("owner"))).groupBy("owner").agg(F.first("text").alias("text"))
    columns = ["key", "copies", "crowd", "start", "windows", "anchor"]
    lists = wanted.groupBy("owner").agg(F.collect_list(F.struct(*columns)).alias("runs"))  # of one text
    slim = F.transform("runs", lambda r: F.struct(*[r[c].alias(c) for c in columns], F.substring(F.col("text"), r["start"] + 1, r["windows"] + (LENGTH - 1)).alias("bytes")))
    return texts.hint("merge").join(lists, "owner").select("owner", F.inline(slim))


def _sorted_out(data: np.ndarray, ends: np.ndarray, windows: list[int], anchor: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(run, first window, windows) of what repeats for certain, and of what is to be compared, of the runs that end at ``ends`` of ``data``.

    A block's windows are at BLOCK distances to the anchor, so equal windows are in blocks of one
    core: others repeat nowhere.  Equal blocks repeat in full and one of each is left.
    """
    view, begin = memoryview(np.ascontiguousarray(data)), 0
    kinds: dict[tuple, list[tuple[int, int, int]]] = {}
    for run, (end, n, a) in enumerate(zip(ends.tolist(), windows, anchor, strict=True)):
        for block in range((a - n + 1) // BLOCK, a // BLOCK + 1):
            last = a - block * BLOCK
            lo, hi = max(0, last - BLOCK + 1), min(n - 1, last)
            core = xxhash.xxh3_64_intdigest(view[begin + last : begin + last - BLOCK + 1 + LENGTH], seed=block % (1 << 32))
            kinds.setdefault((core, block, last - lo, _kind(view[begin + lo : begin + hi + LENGTH])), []).append((run, lo, hi - lo + 1))
        begin = end
    of_core = Counter(k[:2] for k in kinds)
    alike = [x for same in kinds.values() if len(same) > 1 for x in same]
    left: list[tuple[int, int, int]] = []
    for run, lo, n in sorted(same[0] for k, same in kinds.items() if of_core[k[:2]] > 1):
        if left and left[-1][0] == run and sum(left[-1][1:]) == lo:
            run, lo, n = run, left[-1][1], left.pop()[2] + n
        left.append((run, lo, n))
    return np.array(alike, dtype=np.int64).reshape(-1, 3), np.array(left, dtype=np.int64).reshape(-1, 3)


def _compared(data: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows) of what is elsewhere too, by a suffix array of the texts in ``data``, which have so many ``windows`` each."""
    n, sizes = len(windows), windows + LENGTH - 1
    text = np.full(len(data) + n, 255, dtype=np.uint8)  # no byte of UTF-8, between the texts
    start = np.cumsum(sizes + 1) - sizes - 1
    text[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = data
    sa = suffix_array(text)
    shared = common_prefixes(text, sa)[sa]
    is_window = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(is_window, start, 1)
    np.add.at(is_window, start + windows, -1)
    is_window = np.cumsum(is_window)[:-1] > 0
    chain = np.cumsum(shared < LENGTH)
    held = np.bincount(chain, weights=is_window[sa])
    repeats = np.zeros(len(text), dtype=bool)
    repeats[sa] = held[chain] > 1
    repeats &= is_window
    edge = np.flatnonzero(np.diff(np.concatenate([[False], repeats, [False]]).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]  # separators keep texts apart
    of = np.searchsorted(start, lo, side="right") - 1
    return of, lo - start[of], hi - lo


def _shard_repeats(pieces: pa.Table) -> pa.Table:
    """owner, start, windows of what repeats, among runs that are each a kind of their own; of runs with copies nothing need be told."""
    data, ends = _bytes_of(pieces.column("bytes").combine_chunks())
    begins = np.append(0, ends[:-1])
    copies, first = (pieces.column(c).to_numpy() for c in ("copies", "start"))
    found, left = _sorted_out(data, ends, pieces.column("windows").to_pylist(), pieces.column("anchor").to_pylist())
    if len(left):
        run, at, windows = left.T
        of, lo, n = _compared(np.concatenate([data[b : b + k + LENGTH - 1] for b, k in zip((begins[run] + at).tolist(), windows.tolist(), strict=True)]), windows)
        found = np.concatenate([found, np.stack([run[of], at[of] + lo, n], axis=1)])
    run, lo, n = found[copies[found[:, 0]] == 1].T
    return pa.table({"owner": pieces.column("owner").take(pa.array(run)), "start": pa.array((first[run] + lo).astype(np.int32)), "windows": pa.array(n.astype(np.int32))})


def _in_shards(pieces: DataFrame) -> DataFrame:
    """What repeats among the ``pieces``, whose keys are shared by few kinds each."""
    total = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(SHARDS, -(-total // SHARD_BYTES))
    dealt = pieces.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "owner", "start", "windows", "anchor", "copies", "bytes")
    return dealt.groupBy("shard").applyInArrow(_shard_repeats, "owner binary, start int, windows int")


def _cut_up(pieces: DataFrame, width: int) -> DataFrame:
    """Runs of at most ``width`` windows, with the bytes, from those of crowded keys; keys are of what the windows of a block share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["owner", "start", "windows", "anchor", "copies"]
            owner, start, windows, anchor, copies = (batch.column(c).to_pylist() for c in names)
            out = []
            for row, data in enumerate(batch.column("bytes").to_pylist()):
                a, n = anchor[row], windows[row]
                for block in range((a - n + 1) // width, a // width + 1):
                    lo, hi = max(0, a - block * width - width + 1), min(n - 1, a - block * width)  # windows of the run
                    core = data[max(0, a - block * width) : a - block * width - width + 1 + LENGTH]
                    key = xxhash.xxh3_64_intdigest(core, seed=block * 1024 + width) - (1 << 63)
                    own = data[lo : hi + LENGTH]
                    out.append((key, _kind(memoryview(own)), copies[row], owner[row], start[row] + lo, hi - lo + 1, a - lo, own))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(8)]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["key", "kind", "copies", "owner", "start", "windows", "anchor", "bytes"])

    return pieces.select("owner", "start", "windows", "anchor", "copies", "bytes").mapInArrow(cut, "key long, kind binary, copies long, owner binary, start int, windows int, anchor int, bytes binary")


def _copied(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """owner, start, windows of the ``rows`` whose kind several have."""
    several = kinds.where("copies > 1").select(F.col("key").alias("of_key"), F.col("kind").alias("of_kind"))
    return rows.hint("merge").join(several, (F.col("key") == F.col("of_key")) & (F.col("kind") == F.col("of_kind"))).select("owner", "start", "windows")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """owner, start, windows: all windows of all texts that also are elsewhere; rows may overlap or repeat."""
    with arrow_rows(docs.sparkSession):
        rows = stored(runs(docs), "suffix-runs")
        first = F.min(F.struct("owner", "start", "windows", "anchor"))
        kinds = stored(rows.groupBy("key", "kind").agg(F.count("*").alias("copies"), first.alias("run")), "suffix-kinds")
        found = [stored(_copied(rows, kinds).distinct(), "suffix-copied")]
        wanted = stored(kinds.hint("merge").join(_shared_keys(kinds), F.col("key") == F.col("of_key")).select("key", "copies", "crowd", "run.*"), "suffix-wanted")
        pieces = stored(_with_bytes(docs, wanted), "suffix-pieces")
        for width in WIDTHS:
            found.append(stored(_in_shards(pieces.where(F.col("crowd") <= CROWD)), "suffix-found"))
            crowded = pieces.where(F.col("crowd") > CROWD)
            if crowded.isEmpty():
                break
            rows = stored(_cut_up(crowded, width), "suffix-cut")
            kinds = stored(rows.groupBy("key", "kind").agg(F.sum("copies").alias("copies"), first.alias("run")), "suffix-kinds")
            found.append(stored(_copied(rows.where("copies = 1"), kinds), "suffix-copied"))
            live = kinds.hint("merge").join(_shared_keys(kinds), F.col("key") == F.col("of_key")).select("key", "copies", "crowd", F.col("run.owner").alias("of_owner"), F.col("run.start").alias("of_start"))
            bytes_of = rows.select("key", "owner", "start", "windows", "anchor", "bytes").withColumnsRenamed({"key": "row_key"})
            met = (F.col("key") == F.col("row_key")) & (F.col("owner") == F.col("of_owner")) & (F.col("start") == F.col("of_start"))
            pieces = stored(bytes_of.hint("merge").join(live, met).select("owner", "key", "copies", "crowd", "start", "windows", "anchor", "bytes"), "suffix-pieces")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """owner, spans: the bytes to remove of the texts that have any, as (start, end) in order, apart from each other."""
    each = repeated_windows(docs).groupBy("owner").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("end"))).alias("spans"))  # of one text

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, offsets = column.flatten(), np.append(0, np.cumsum(pc.list_value_length(column).to_numpy()))
            lo, hi = (flat.field(i).to_numpy() for i in range(2))
            out = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                order = np.argsort(lo[a:b], kind="stable")
                s, e = lo[a:b][order], np.maximum.accumulate(hi[a:b][order])
                new = np.append(True, s[1:] > e[:-1])
                out.append([{"start": int(x), "end": int(y)} for x, y in zip(s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["owner", "spans"])

    return stored(each.mapInArrow(join, "owner binary, spans array<struct<start:int,end:int>>"), "suffix-spans")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns of ``docs``), kept (the remaining bytes of the text), n_bytes, spans (removed bytes, as (start, end)).

    Texts are read whole, as UTF-8 bytes; a null text is empty and shorter ones
    than LENGTH lose nothing.  A byte goes if a string of LENGTH bytes around it
    also starts anywhere else, in the same or another row; overlaps count, and
    strings never cross rows.  Rows of the same text are copies of each other,
    whatever their doc_ids: both lose all that is in strings.  What stays may
    not be UTF-8, as strings may begin inside a character.  All columns pass
    through inside ``row``, whatever their names; an empty table gives no row.
    """
    spans = repeated_spans(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col("row.text").cast("string").cast("binary"), F.lit(b""))
    keyed = docs.select(row).withColumns({"owner": _owner(F.col("row.text"))}).withColumn("maybe", _maybe_among(spans)(F.col("owner")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = keyed.where(~F.col("maybe")).select("row", none.alias("spans"))
    met = keyed.where("maybe").hint("merge").join(spans.withColumnRenamed("owner", "of_owner"), F.col("owner") == F.col("of_owner"), "left").select("row", F.coalesce("spans", none).alias("spans"))
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("spans"), i - 1)["end"])
    rest = F.transform("spans", lambda s, i: F.substring(text, begin(i) + 1, s["start"] - begin(i)))
    last = F.coalesce(F.element_at("spans", -1)["end"], F.lit(0))
    kept = F.aggregate(rest, F.lit(b""), lambda done, x: F.concat(done, x), lambda done: F.concat(done, F.substring(text, last + 1, F.octet_length(text))))
    return whole.unionByName(met).select("row", F.when(F.size("spans") == 0, text).otherwise(kept).alias("kept"), F.octet_length(text).cast("long").alias("n_bytes"), "spans")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 400 bytes, by the hexadecimal digits of the texts, in slices of 2,000 starts.
OP12_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, octet_length(b) AS n, hex(b) AS x FROM d),
c AS (SELECT doc_id, n, k, substr(x, k * 4000 + 1, 4000 + 798) AS x FROM h, range(0, (n + 1999) // 2000) AS t(k)),
w AS MATERIALIZED (SELECT doc_id, k * 2000 + i AS pos, md5(substr(x, i * 2 + 1, 800)) AS m FROM c, range(0, least(2000, n - k * 2000 - 399)) AS t(i)),
r AS (SELECT doc_id, pos FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
e AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM r),
g AS (SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM e),
s AS (SELECT doc_id, g, min(pos) AS lo, max(pos) + 400 AS hi FROM g GROUP BY doc_id, g),
b AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS last FROM s),
k AS (SELECT b.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS hi, string_agg(substr(h.x, (last * 2 + 1)::BIGINT, ((lo - last) * 2)::BIGINT), '' ORDER BY lo) AS x FROM b JOIN h ON h.doc_id = b.doc_id GROUP BY b.doc_id)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.x || substr(h.x, (k.hi * 2 + 1)::BIGINT), h.x))) AS kept_sha256
FROM h LEFT JOIN k ON k.doc_id = h.doc_id"""
