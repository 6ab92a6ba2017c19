"""Near dedup by Jaccard similarity of five-word shingles: SimHash by a byte-position inverted index with count filtering, exactly.

It is the method of ``llm.simhash`` with five-word shingles and with more byte
positions.  Every shingle falls into one of P positions by its hash, and the
eight bytes of a position are the SimHash of the shingles in it.  Of two sets
that are at least 0.8 similar, n and m in size, at most (n + m) // 9 shingles are
in one only, so the fingerprints differ in as many positions at most, and share
all others.  The index posts positional bytes; a pair is a candidate only if the
tally of the entries that it shares reaches the guaranteed count, and is then
compared on its whole sets, so no pair is lost.

P is twice the power of two below n.  Sizes up to 1.25 times a power also post
under the P below, so similar sets always meet in one.  Under WHOLE shingles each
has a position to itself.  It takes 1e-16 of chance or less for so many shingles of
a set to share positions that the count isn't met.

Of its positions a set posts as many as may differ and k, which grows with n, the
first ones of any one order: such prefixes still share k (Chaudhuri et al. 2006).
The order is by position, but those that hold only frequent shingles come last, so
that a stock passage leaves the prefixes of all texts that have enough besides.
Frequent are shingles of more than one in FREQUENT texts, by counts of every
text that each task keeps for itself and that are added up; at most FREQUENT
times the mean number of shingles are, whatever the corpus.

Copies are folded first.  A text with fewer shared entries than any similar
text would need is dropped at once.  A sketch of two to four bits a shingle holds the
parity of the shingles that fall on each bit: two sets differ in at least as
many shingles as their sketches in bits, so a pair whose sketches are too far
apart is dropped before any set is sent.

Entries of up to SMALL_ENTRY texts are joined pair by pair.  Larger ones are
split by length, and each text is compared with the first of its part.  That
connects most near copies; parts whose texts are all in one component are done.
In the others, each text outside the main component is compared with the nearest
one of another component, by sketch, for as long as that finds links.  In what is
left, texts with near sketches in different components are pairs to
compare; a part with over PARTNERS such pairs a text yields a spanning forest
of the links of its sets instead, so that rows stay linear.  Sets are computed
only for candidates: a bitmap of fixed size goes to the tasks and drops nearly
all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoscan.llm.common import arrow_rows, freed, giving_back, stored, text_slices
from orthoscan.llm.components import connected_components
from orthoscan.llm.simhash import majority_bits, shingle_hashes

SHINGLE = 5
SMALL_ENTRY = 32
#: Least bits of the sketch of a set, a power of two from 64.
SKETCH = 512
#: Pairs a text up to which a part of a large entry is compared pair by pair.
PARTNERS = 2
#: Rounds in which each text of a part is compared with its nearest one of another component.
TURNS = 4
#: Distances of sketches that a task holds at a time.
DISTANCES = 1 << 20
#: Bits of the bitmap of texts that share an entry; and tasks that make it.
SIEVE_BITS, SIEVE_PARTS = 1 << 25, 8


#: k is 1 + n // TALLY.
TALLY = 20
#: Shingles from which on a set's fingerprint has fewer positions than hashes, a power of two.
WHOLE = 32
#: Bytes of text that are fingerprinted at a time.
SLICE = 1 << 20
#: One in so many texts makes a shingle frequent, and at least so many texts; and counts that a task holds at most.
FREQUENT, LEAST, HELD = 20_000, 16, 1 << 20


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, read whole."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), dtype=np.uint64).view(np.int64))


def text_key(text: str | None) -> int:
    """Equal for texts of the same words."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), 7) - (1 << 63)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of the hashes that fall on each of 2 ** k bits, from two bits a hash."""
    bits = max(SKETCH, 1 << (2 * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same hashes in ``size`` words, no more than it has."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their counts added up; beyond HELD of them the least counts go, and all others lose as much (Misra, Gries 1982)."""
    order = np.argsort(hashes, kind="stable")  # mostly sorted already
    hashes = hashes[order]
    starts = np.flatnonzero(np.append(len(hashes) > 0, hashes[1:] != hashes[:-1]))
    total = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
    found = hashes[starts]
    if len(found) > HELD:
        total -= np.partition(total, len(total) - HELD - 1)[len(total) - HELD - 1]
        found, total = found[total > 0], total[total > 0]
    return found, total


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that many of ``texts`` (doc_id, text) have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts, texts_seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        for batch in (x for b in giving_back(batches) for x in text_slices(b, 1)):
            own = np.concatenate([shingle_set(t) for t in batch.column(1).to_pylist()])
            found, counts = _added(np.concatenate([found, own]), np.concatenate([counts, np.ones(len(own), dtype=np.int64)]))
            texts_seen += len(batch)
        most = counts >= max(2, texts_seen / FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array(found[most]), pa.array(counts[most])], ["hash", "texts"])

    many = max(LEAST, texts.count() / FREQUENT)
    sums = texts.mapInArrow(freed(count), "hash long, texts long").groupBy("hash").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= many)
    return np.sort(sums.select("hash").toArrow().column(0).to_numpy())


def _views(n: int) -> list[tuple[int, int]]:
    """(P, positions to post) of each fingerprint of a set of n shingles; P is 0 where each shingle has a position to itself."""
    k = 1 + n // TALLY
    if n < WHOLE:
        return [(0, n // 5 + k)]
    base = 1 << (n.bit_length() - 1)
    views = [(2 * base, (n + 5 * n // 4) // 9 + k)]
    if 4 * n <= 5 * (base - 1):  # a similar set may have fewer than ``base``
        views.append((base, (n + base - 1) // 9 + k) if base > WHOLE else (0, n // 5 + k))
    return views


def positional_entries(sets: list[np.ndarray], frequent: np.ndarray) -> list[np.ndarray]:
    """The index entries that each of the sorted ``sets`` posts: its first positional bytes, those of frequent shingles last."""
    views = [(i, *v) for i, s in enumerate(sets) if len(s) for v in _views(len(s))]
    if not views:
        return [np.zeros(0, dtype=np.int64) for _ in sets]
    owner, size, most = (np.array(c, dtype=np.int64) for c in zip(*views, strict=True))
    lengths = np.array([len(sets[i]) for i in owner])
    flat, view = np.concatenate([sets[i] for i in owner]).view(np.uint64), np.repeat(np.arange(len(views)), lengths)
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.where(size[view] > 0, (flat >> np.uint64(32)).astype(np.int64) & (size[view] - 1), rank)
    order = np.argsort((view << 32) | at, kind="stable")
    flat, view, at = flat[order], view[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], (view[1:] != view[:-1]) | (at[1:] != at[:-1])]))
    counts = np.diff(np.append(starts, len(flat)))
    found = flat[starts]  # the majority of one is itself
    several = np.flatnonzero(counts > 1)
    if len(several):
        own = counts[several]
        begins = np.cumsum(own) - own
        found[several] = majority_bits(flat[np.repeat(starts[several] - begins, own) + np.arange(own.sum())], begins)
    late = np.zeros(len(starts), dtype=bool)
    if len(frequent):
        signed = flat.view(np.int64)
        there = np.searchsorted(frequent, signed)
        late = np.logical_and.reduceat(frequent[np.minimum(there, len(frequent) - 1)] == signed, starts)
    view, at = view[starts], at[starts]
    order = np.argsort(2 * view + late, kind="stable")
    found, view, at = found[order], view[order], at[order]
    rank = np.arange(len(view)) - np.searchsorted(view, np.arange(len(views)))[view]
    posted = rank < most[view]
    found, view, at = found[posted], view[posted], at[posted]
    place = (size[view] << 32 | at).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = np.where(size[view] > 0, found ^ place ^ (place >> np.uint64(32)), found).view(np.int64)
    return np.split(found, np.searchsorted(owner[view], np.arange(1, len(sets))))


def prefix_of(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """What one sorted set posts."""
    return positional_entries([hashes], frequent)[0]


def prefixes(texts: DataFrame) -> DataFrame:
    """doc_id, key, n, prefix (the entries that its fingerprints post), sketch of every row of ``texts`` (doc_id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in giving_back(batches) for x in text_slices(b, 1, SLICE)):
            rows = batch.column(1).to_pylist()
            sets = [shingle_set(t) for t in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_key(t) for t in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(positional_entries(sets, shared.value)), _lists([sketch(s) for s in sets])], ["doc_id", "key", "n", "prefix", "sketch"])

    return texts.mapInArrow(freed(cut), "doc_id long, key long, n long, prefix array<long>, sketch array<long>")


def _sieve(keys: DataFrame) -> np.ndarray:
    """Bitmap of ``keys`` (one long column), modulo SIEVE_BITS."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE_BITS, dtype=bool)
        for batch in batches:
            bits[batch.column(0).to_numpy() & (SIEVE_BITS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(SIEVE_BITS // 8, dtype=np.uint8)
    for part in keys.coalesce(SIEVE_PARTS).mapInArrow(freed(mark), "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(part[0]), dtype=np.uint8)
    return out


def _among(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """``nodes`` (key, n, prefix) with a key among ``keys``, and a few others."""
    shared = nodes.sparkSession.sparkContext.broadcast(_sieve(keys))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() & (SIEVE_BITS - 1)
            yield batch.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

    return nodes.select("key", "n", "prefix").mapInArrow(freed(keep), "key long, n long, prefix array<long>")


def shingle_sets(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """key, n, hashes of the ``texts`` (doc_id, text) with a key among ``keys``."""
    shared = texts.sparkSession.sparkContext.broadcast(_sieve(keys))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in (x for b in giving_back(batches) for x in text_slices(b, 1, SLICE)):
            found = [(k, shingle_set(t)) for t in batch.column(1).to_pylist() if bits[((k := text_key(t)) & (SIEVE_BITS - 1)) >> 3] >> (7 - (k & 7)) & 1]
            sets = [s for _, s in found]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["key", "n", "hashes"])

    made = texts.mapInArrow(freed(cut), "key long, n long, hashes array<long>")
    return made.join(keys, "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))


def similar(common: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles with ``common`` shared ones have a Jaccard similarity of 0.8 or more."""
    return 9 * common >= 4 * (n + m)


def spanning_links(keys: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A forest that connects exactly what pairs of similar sets connect."""
    sizes = np.array([len(s) for s in sets])
    flat, ends = np.concatenate(sets), np.cumsum(sizes)
    rest, a, b = np.arange(len(keys)), [], []
    at = np.repeat(np.arange(len(keys)), sizes)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            own = flat[ends[i] - sizes[i] : ends[i]]
            there = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.bincount(at[own[there] == flat], minlength=len(keys))
            near = 9 * common[rest] >= 4 * (sizes[rest] + sizes[i])
            a += [int(keys[i])] * int(near.sum())
            b += keys[rest[near]].tolist()
            queue.extend(rest[near].tolist())
            rest = rest[~near]
    return a, b


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = spanning_links(pdf.key.to_numpy("int64"), [np.asarray(h, dtype=np.int64) for h in pdf.hashes])
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


class _Part:
    """The texts of a part of an entry: which may be similar to one of another component, by length and sketch.

    Texts of the component that most of them are in are compared with the others only.
    """

    def __init__(self, pdf: pd.DataFrame):
        size = pdf["sketch"].map(len).min()
        self.bits = np.stack([folded(np.asarray(x), size) for x in pdf["sketch"]]).view(np.uint64)
        self.key, self.n, self.root = (pdf[c].to_numpy("int64") for c in ("key", "n", "root"))
        roots, counts = np.unique(self.root, return_counts=True)
        self.minor = np.flatnonzero(self.root != roots[counts.argmax()])

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of texts outside the main component, bits that their sketches differ in from those of all, which may be similar)."""
        step = max(1, DISTANCES // len(self.n))
        for lo in range(0, len(self.minor), step):
            own = self.minor[lo : lo + step]
            far = np.zeros((len(own), len(self.n)), dtype=np.int64)
            for word in range(self.bits.shape[1]):
                far += np.bitwise_count(self.bits[own, word, None] ^ self.bits[:, word])
            yield own, far, (9 * far <= self.n[own, None] + self.n) & (self.root[own, None] != self.root)


def _partners(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each text outside the main component of a part, the text of another component that its sketch is nearest to."""
    part, found = _Part(pdf), []
    for own, far, near in part.rows():
        share = np.where(near, far / (part.n[own, None] + part.n), np.inf)
        best = share.argmin(axis=1)
        some = near[np.arange(len(own)), best]
        found.append(np.stack([part.key[own[some]], part.key[best[some]]]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _suspects(pdf: pd.DataFrame) -> pd.DataFrame:
    """What may be similar to a text of another component, in a part of an entry: pairs, or texts where pairs are many."""
    part = _Part(pdf)
    is_minor = np.zeros(len(part.n), dtype=bool)
    is_minor[part.minor] = True
    met, pairs, few = np.zeros(len(part.n), dtype=bool), [np.zeros((2, 0), dtype=np.int64)], PARTNERS * len(part.n)
    for own, _, near in part.rows():
        met[own] |= near.any(axis=1)
        met |= near.any(axis=0)
        if few >= 0:
            a, b = np.nonzero(near & (~is_minor | (part.key[own, None] < part.key)))
            pairs.append(np.stack([part.key[own[a]], part.key[b]]))
            few -= len(a)
    if few >= 0:
        a, b = np.concatenate(pairs, axis=1)
        return pd.DataFrame({"entry": pdf["entry"].iloc[0], "band": pdf["band"].iloc[0], "a": a, "b": pd.array(b, dtype="Int64")})
    rest = pdf.loc[met, ["entry", "band", "key"]].rename(columns={"key": "a"})
    return rest.assign(b=pd.array([None] * len(rest), dtype="Int64"))


def _close(a: str, b: str) -> Column:
    """Whether the lengths and sketches of two sets allow them to be similar; of such lengths, one sketch is twice the other at most."""
    x, y = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    xor = lambda p, q: p.bitwiseXOR(q)
    fold = lambda s, t: F.when(F.size(s) > F.size(t), F.zip_with(F.slice(s, F.lit(1), F.size(t)), F.slice(s, F.size(t) + 1, F.size(t)), xor)).otherwise(s)
    far = F.aggregate(F.zip_with(fold(x, y), fold(y, x), xor), F.lit(0), lambda total, w: total + F.bit_count(w))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (9 * far <= n + m)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (key, n, hashes) are similar."""
    of = lambda end: sets.select(F.col("key").alias(end), F.col("n").alias(f"n_{end}"), F.col("hashes").alias(f"hashes_{end}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    return met.where(similar(F.size(F.array_intersect("hashes_a", "hashes_b")), F.col("n_a"), F.col("n_b"))).select("a", "b")


def groups(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root of the keys that have similar texts; ``nodes`` has key, n, prefix and sketch, a row a key."""
    posted = lambda df: df.select("key", "n", F.explode("prefix").alias("entry"))
    sizes = stored(posted(nodes).groupBy("entry").agg(F.count("*").alias("size")).where("size > 1"), "similar-entries").hint("merge")
    tally = lambda n: 1 + F.floor(n / TALLY)
    # The lesser of two similar sets has at least 0.8 n shingles.  The others' postings never meet the sizes a second time.
    live = posted(nodes).join(sizes.select("entry"), "entry").groupBy("key").agg(F.count("*").alias("shared"), F.first("n").alias("n")).where(F.col("shared") >= tally(F.floor((4 * F.col("n") + 4) / 5)))
    sized = stored(posted(_among(nodes, stored(live.select("key"), "similar-live"))).join(sizes, "entry"), "similar-sized")
    small, large = sized.where(F.col("size") <= SMALL_ENTRY), sized.where(F.col("size") > SMALL_ENTRY)
    near = (F.col("l.n") * 5 >= F.col("r.n") * 4) & (F.col("r.n") * 5 >= F.col("l.n") * 4)
    met = small.alias("l").join(small.alias("r"), (F.col("l.entry") == F.col("r.entry")) & (F.col("l.key") < F.col("r.key")) & near)
    met = met.groupBy(F.col("l.key").alias("a"), F.col("r.key").alias("b")).agg(F.count("*").alias("shared"), F.first(F.least("l.n", "r.n")).alias("least"))
    met = met.where(F.col("shared") >= tally(F.col("least"))).select("a", "b")  # pairs of large entries are found there
    # Lengths of similar sets differ by a factor of 1.25 at most: they are in the same band or in bands next to each other.
    band = F.floor(F.log("n") / F.log(F.lit(1.25)) - 1e-9)
    parts = large.select("key", "entry", F.explode(F.array(band, band + 1)).alias("band"))
    firsts = stored(parts.groupBy("entry", "band").agg(F.min("key").alias("a")), "similar-firsts")
    met = met.unionByName(parts.join(firsts, ["entry", "band"]).where("a < key").select("a", F.col("key").alias("b"))).distinct()
    brief = nodes.select("key", "n", "sketch")
    pairs = met.join(brief.alias("x"), F.col("a") == F.col("x.key")).join(brief.alias("y"), F.col("b") == F.col("y.key")).where(_close("x", "y"))
    pairs = stored(pairs.select("a", "b"), "similar-pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(large.select("key")).distinct(), "similar-wanted")
    with arrow_rows(texts.sparkSession):
        sets = stored(shingle_sets(texts, wanted), "similar-sets")
    roots = stored(connected_components(_linked(pairs, sets)), "similar-roots")
    for turn in range(TURNS + 1):
        rooted = stored(parts.join(roots.withColumnRenamed("node", "key"), "key", "left").select("entry", "band", "key", F.coalesce("root", "key").alias("root")), "similar-rooted")
        mixed = stored(rooted.groupBy("entry", "band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("entry", "band"), "similar-mixed")
        if mixed.isEmpty():
            return roots
        open_parts = rooted.join(mixed, ["entry", "band"]).join(brief, "key")
        if turn == TURNS:
            break
        tried = open_parts.groupBy("entry", "band").applyInPandas(_partners, "a long, b long").distinct()
        links = stored(_linked(stored(tried, "similar-tried"), sets), "similar-links")
        if links.isEmpty():
            break
        roots = stored(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "similar-roots")
    suspects = stored(open_parts.groupBy("entry", "band").applyInPandas(_suspects, "entry long, band long, a long, b long"), "similar-suspects")
    if suspects.isEmpty():
        return roots
    more = _linked(suspects.where("b IS NOT NULL").select("a", "b").distinct(), sets)
    crowded = suspects.where("b IS NULL").select("entry", "band", F.col("a").alias("key")).join(sets.select("key", "hashes"), "key")
    more = more.unionByName(crowded.groupBy("entry", "band").applyInPandas(_forest, "a long, b long"))
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of similar texts: the one with the smallest doc_id.

    Texts are read whole and cut into words as for fingerprints.  Two are
    linked if the Jaccard similarity of their sets of five-word shingles is 0.8
    or more; fewer words make one shingle.  A group is what links connect.
    Texts without words are one group.  All columns pass through.  Rows that
    share the staying doc_id all stay, and so do rows without a doc_id in
    groups without any.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession):
        nodes = stored(prefixes(texts).groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "similar-nodes")
    roots = groups(texts, nodes)
    grouped = nodes.select("key", "first_id").join(roots.withColumnRenamed("node", "key"), "key", "left")
    staying = grouped.groupBy(F.coalesce("root", "key").alias("group")).agg(F.min("first_id").alias("staying")).select("staying").distinct()
    staying = stored(staying, "similar-staying")
    return docs.join(staying.hint("merge"), docs["doc_id"].eqNullSafe(staying["staying"]), "left_semi")
