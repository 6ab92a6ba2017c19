"""Language-model scoring with a probabilistic suffix tree (Ron, Singer, Tishby 1996).

A text is read as the bytes of its words, A-Z lower-cased, with a space between
words and an end symbol; the tree predicts each symbol from the symbols before
it.  All training texts are counted, as grams of DEPTH + 1 symbols.  A context
is a candidate if at least MIN_COUNT symbols follow it, and it is retained if
the symbols that follow it diverge from those its longest retained suffix
predicts.  A symbol is scored in the longest retained suffix of what precedes
it; the counts there are smoothed with the prediction of the next shorter one.

MIN_COUNT is a number of symbols, not a share, so the tree grows with the
corpus.  It is never in one place: the grams of all texts, training texts or
not, are a table, parted by the two symbols before the predicted one.  All
longer contexts are whole within a part, which computes its levels upwards, and
so holds the log10 probability of every gram that will be scored.

Texts meet those probabilities in two ways.  At most HEAVY_GRAMS grams are each
at least 1 / HEAVY_GRAMS of all symbols; they go to every task.  The others are
joined, one row per text and distinct gram.  Words meet their counts, for the
word-unigram base score, in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.llm.common import arrow_rows, freed, id_remainder, stored, table, text_slices, texts_of

DEPTH = 6
#: Symbols that must follow a context in the training texts.
MIN_COUNT = 50
#: Bits by which a context's next symbols must diverge from those of its suffix.
MIN_DIVERGENCE = 0.01
#: Weight of the shorter context's prediction, in symbols.
PRIOR = 40.0
#: What goes to every task at most: 12 bytes a gram; a word and its log count.
HEAVY_GRAMS, HEAVY_WORDS = 30_000_000, 200_000
#: Symbols of all texts a part of the gram table.
PART_SYMBOLS = 16 << 20
END = b"\n"  # never part of a word
_SLICE, _BLOCK, _SHARE, _HELD_GRAMS, _HELD_WORDS = 1 << 20, 1 << 20, 1 << 18, 800_000, 400_000
_SYMBOLS, _TAGS = 256, 256


def _words(texts: pa.Array) -> pa.Array:
    """The lower-cased words of each text; none for nulls and blanks."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts_of(texts))))
    blank = pc.equal(pc.binary_join(lists, pa.scalar("", pa.large_string())), "").to_numpy(zero_copy_only=False)
    sizes = np.where(blank, 0, pc.list_value_length(lists).to_numpy())
    flat = lists.flatten()
    flat = flat.filter(pc.not_equal(flat, "")) if blank.any() else flat
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)


def _tallies(words: pa.Array, tags: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct (gram << 8 | tag of its text), and how often each occurs, block by block."""
    texts = pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()
    pad = END * DEPTH
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, END)), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    runs = np.stack([np.full(len(sizes), DEPTH), sizes], axis=1).reshape(-1)
    inside = np.repeat(np.tile([False, True], len(sizes)), runs)
    tag = np.repeat(tags.astype(np.uint8), sizes + DEPTH)
    for lo in range(DEPTH, len(data), _BLOCK):
        hi = min(lo + _BLOCK, len(data))
        key = np.zeros(hi - lo, dtype=np.uint64)
        for j in range(DEPTH, -1, -1):
            key = (key << np.uint64(8)) | data[lo - j : hi - j]
        yield _counted(((key << np.uint64(8)) | tag[lo:hi])[inside[lo:hi]])


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of ``n`` (1 each if None)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n, first) if len(keys) else n


_BLOBS = "part int, size int, grams binary, n binary, everywhere binary"


def _packed(x: np.ndarray) -> bytes:
    """Small or slowly growing numbers in few bytes: their differences, byte by byte, compressed."""
    steps = np.diff(x.view(np.int64), prepend=np.int64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    steps = np.frombuffer(pa.decompress(packed, 8 * size, codec="zstd"), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.int64).reshape(-1))


def _placed(x: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on; those below 65,536 are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def _parted(part: np.ndarray, gram: np.ndarray, n: np.ndarray, everywhere: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row a part: its number, how many grams it has, and its share of each column."""
    if len(part):
        order = _placed(part)
        first = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
        runs = [order[i:j] for i, j in zip(first.tolist(), np.append(first[1:], len(order)).tolist(), strict=True)]
        packed = [pa.array([_packed(c[run]) for run in runs], pa.binary()) for c in (gram, n, everywhere)]
        yield pa.RecordBatch.from_arrays([pa.array(part[order][first], pa.int32()), pa.array([len(r) for r in runs], pa.int32()), *packed], ["part", "size", "grams", "n", "everywhere"])


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """grams, n, everywhere of a few rows of _BLOBS at a time: at most _SHARE grams, or one row."""
    for batch in batches:
        sizes = batch.column("size").to_pylist()
        ends, lo = np.cumsum(np.array(sizes, dtype=np.int64)), 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _SHARE, side="right")))
            gram, n, everywhere = (np.concatenate([_unpacked(x.as_py(), size) for x, size in zip(batch.column(c)[lo:hi], sizes[lo:hi], strict=True)]) for c in ("grams", "n", "everywhere"))
            yield gram.view(np.uint64), n, everywhere
            lo = hi


class _Sums:
    """Sorted distinct grams with two sums each, merged whenever as many again as are distinct, and many, are held."""

    def __init__(self):
        self.columns, self.size, self.most = ([], [], []), 0, 2 * _HELD_GRAMS

    def add(self, *columns: np.ndarray) -> None:
        for held, column in zip(self.columns, columns, strict=True):
            held.append(column)
        self.size += len(columns[0])
        if self.size > self.most:
            self.merge()

    def _taken(self, k: int, kind: type) -> np.ndarray:
        """A column, of which the pieces are let go, so that one column at a time is there twice."""
        column = np.concatenate([*self.columns[k], np.zeros(0, kind)])
        self.columns[k].clear()
        return column

    def merge(self) -> tuple[np.ndarray, ...]:
        few = len(self.columns[0]) <= 16  # a few sorted pieces are merged rather than sorted anew
        gram = self._taken(0, np.uint64)
        order = np.argsort(gram, kind="stable" if few else None)
        gram = gram[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else order
        gram = gram[first]
        merged = (gram, *(np.add.reduceat(x[order], first) if len(first) else x for x in (self._taken(k, np.int64) for k in (1, 2))))
        self.size, self.columns = len(first), tuple([column] for column in merged)
        self.most = 2 * max(_HELD_GRAMS, self.size)
        return merged


def _mixed(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def gram_counts(texts: DataFrame, parts: int) -> DataFrame:
    """Every gram with its occurrences in training texts and in all texts (text, training boolean), as _BLOBS.

    Each gram is in one row, and grams whose two symbols before the last are
    the same have the same ``part`` (0 to ``parts`` - 1).  Tasks send sorted
    distinct grams as bytes, so that sums cost no row each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in (x for b in batches for x in text_slices(b, 0, _SLICE)):
            for keys, n in _tallies(_words(batch.column(0)), np.array(batch.column(1))):
                sums.add(keys >> np.uint64(8), n * (keys & np.uint64(1)).astype(np.int64), n)
            if sums.size > _HELD_GRAMS:
                gram, *columns = sums.merge()
                if sums.size > _HELD_GRAMS // 2:
                    yield from _parted(_mixed(gram, parts), gram, *columns)
                    sums = _Sums()
        gram, *columns = sums.merge()
        yield from _parted(_mixed(gram, parts), gram, *columns)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for share in _shares(batches):
            sums.add(*share)
        gram, *columns = sums.merge()
        yield from _parted(_mixed(gram >> np.uint64(8) & np.uint64(0xFFFF), parts), gram, *columns)

    return texts.mapInArrow(freed(count), _BLOBS).repartition(parts, "part").mapInArrow(freed(merge), _BLOBS)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n, everywhere: as for grams, the end of each text included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (x for b in batches for x in text_slices(b, 0, _SLICE)):
            lists, training = _words(batch.column(0)), np.array(batch.column(1)).astype(np.int64)
            words = lists.flatten().cast(pa.large_binary()).dictionary_encode()
            codes, own = words.indices.to_numpy(), np.repeat(training, pc.list_value_length(lists).to_numpy())
            n, everywhere = (np.bincount(codes, weights=w, minlength=len(words.dictionary)).astype(np.int64) for w in (own, None))
            held.append(pa.table({"word": words.dictionary, "n": n, "everywhere": everywhere}))
            held.append(pa.table({"word": pa.array([END], pa.large_binary()), "n": [int(training.sum())], "everywhere": [len(training)]}))
            size += len(words.dictionary)
            if size > _HELD_WORDS:
                held = [merged(held)]
                size = len(held[0])
                if size > _HELD_WORDS // 2:
                    yield from as_batches(held[0])
                    held, size = [], 0
        if held:
            yield from as_batches(merged(held))

    def merged(held: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(held)
        coded = whole.column("word").combine_chunks().dictionary_encode()
        sums = (np.bincount(coded.indices.to_numpy(), weights=whole.column(c).to_numpy(), minlength=len(coded.dictionary)).astype(np.int64) for c in ("n", "everywhere"))
        return pa.table([coded.dictionary, *map(pa.array, sums)], ["word", "n", "everywhere"])

    def as_batches(counted: pa.Table) -> list[pa.RecordBatch]:
        return counted.select(["word", "n", "everywhere"]).cast(pa.schema([("word", pa.binary()), ("n", pa.int64()), ("everywhere", pa.int64())])).to_batches(max_chunksize=100_000)

    return texts.mapInArrow(freed(count), "word binary, n long, everywhere long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere"))


def _smoothed(keys: np.ndarray, n: np.ndarray, shorter: np.ndarray, min_count: float, min_divergence: float, prior: float) -> np.ndarray:
    """Probability of the last symbol of each of the sorted ``keys`` (whole contexts), given that of the next shorter context."""
    context = keys >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    total = np.add.reduceat(n, first).astype(float)
    share = n / np.maximum(total, 1)[of]
    bits = np.add.reduceat(share * np.log2(np.where(n > 0, share / shorter, 1.0)), first)
    kept = ((total >= min_count) & (bits >= min_divergence))[of]
    return np.where(kept, (n + prior * shorter) / (total[of] + prior), shorter)


def fit_tree(counted: DataFrame, parts: int, depth: int = DEPTH, min_count: int = MIN_COUNT, min_divergence: float = MIN_DIVERGENCE, prior: float = PRIOR) -> DataFrame:
    """gram, everywhere, log: the log10 probability of the last symbol of every gram of ``counted``.

    It is the probability in the longest retained suffix of the symbols before.
    Counts of one and two symbols are summed for all (256 and 65,536 rows at
    most); longer contexts are whole within a part, level by level.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 16, dtype=np.int64)
        for gram, n, _ in _shares(batches):
            np.add.at(sums, gram & np.uint64(0xFFFF), n)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], ["pair", "n"])

    found = counted.mapInArrow(freed(pairs), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << 16, dtype=np.int64)
    n[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    one = n.reshape(_SYMBOLS, _SYMBOLS).sum(axis=0)
    two = _smoothed(np.arange(1 << 16, dtype=np.uint64), n, np.tile((one + 1) / (one.sum() + _SYMBOLS), _SYMBOLS), min_count, min_divergence, prior)
    shared = counted.sparkSession.sparkContext.broadcast(two)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for share in _shares(batches):
            sums.add(*share)
        gram, n, everywhere = sums.merge()
        if not len(gram):
            return
        p, below = shared.value, np.arange(1 << 16, dtype=np.uint64)
        for k in range(2, depth + 1):
            keys, back = np.unique(gram & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            shorter = p[np.searchsorted(below, keys & np.uint64((1 << 8 * k) - 1))]
            p, below = _smoothed(keys, np.bincount(back, weights=n, minlength=len(keys)), shorter, min_count, min_divergence, prior), keys
        out = pa.table({"gram": gram.view(np.int64), "everywhere": everywhere, "log": np.log10(p[back])})
        yield from out.to_batches(max_chunksize=100_000)

    return counted.repartition(parts, "part").mapInArrow(freed(levels), "gram long, everywhere long, log double")


def score_texts(docs: DataFrame, is_training: Column, depth: int = DEPTH, **fit) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    ``is_training`` is a condition on doc_id (null counts as false); the texts
    of those rows are learned from.  Null and empty texts have one token, their
    end.  Texts are read whole.  Repeated rows count, and are scored, each for
    itself.  Without any training row every symbol is as likely as any other
    and the base is 0.  Extra columns are ignored; an empty table gives no row.
    ``fit`` goes to ``fit_tree``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(is_training, F.lit(False)).alias("training"))
    texts = rows.select("text", "training")
    with arrow_rows(spark, 4 * _TAGS):
        words = stored(word_counts(texts), "lm-words")
    tokens, distinct, tokens_everywhere = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum("everywhere"), F.lit(0))).first()
    heavy = words.where((F.col("everywhere") >= tokens_everywhere / HEAVY_WORDS) | (F.col("word") == F.lit(END))).select("word", "n").collect()  # HEAVY_WORDS at most, and the end
    known = pa.array([bytes(w) for w, _ in heavy], pa.large_binary()), np.log10(np.array([n for _, n in heavy], dtype=float) + 1)
    symbols = words.agg(F.coalesce(F.sum(F.col("everywhere") * (F.octet_length("word") + 1)), F.lit(0))).first()[0]
    parts = 1 + symbols // PART_SYMBOLS
    with arrow_rows(spark, 4 * _TAGS):
        probable = stored(fit_tree(stored(gram_counts(texts, parts), "lm-grams"), parts, depth, **fit), "lm-probabilities")
    is_frequent = F.col("everywhere") >= symbols / HEAVY_GRAMS
    frequent = probable.where(is_frequent).select("gram", "log").toArrow()  # HEAVY_GRAMS at most
    keys = frequent.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((known, keys[order], frequent.column("log").to_numpy()[order].astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId() << 36, 0
        for some in (x for b in batches for k in range(0, len(b), _TAGS) for x in text_slices(b.slice(k, _TAGS), 1, _SLICE)):
            yield _scored(some, part + row, *shared.value)
            row += len(some)

    with arrow_rows(spark, 4 * _TAGS):
        own = stored(rows.select("doc_id", "text").mapInArrow(freed(score), _SCORED), "lm-scored")
    each = lambda what, key: own.select("uid", F.inline(F.arrays_zip(F.col(what).alias(key), F.col(f"{what}_times").alias("times"))))
    from_words = each("words", "word").join(words.select("word", "n"), "word").groupBy("uid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_hits"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"),
    )
    from_grams = each("grams", "gram").join(probable.where(~is_frequent).select("gram", "log"), "gram").groupBy("uid").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))
    return own.select("uid", "doc_id", "n_tokens", "hits", "base", "score").join(from_words, "uid", "left").join(from_grams, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("hits") + F.coalesce("more_hits", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


_SCORED = "uid long, doc_id long, n_tokens long, hits long, base double, score double, words array<binary>, words_times array<long>, grams array<long>, grams_times array<long>"


def _scored(batch: pa.RecordBatch, uid: int, known: tuple[pa.Array, np.ndarray], heavy: np.ndarray, logs: np.ndarray) -> pa.RecordBatch:
    """What the frequent words and grams give each text (doc_id, text), and its other words and grams with their numbers."""
    size = len(batch)
    lists = _words(batch.column(1))
    lengths = pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().cast(pa.large_binary()).dictionary_encode()
    pairs, times = _counted(np.repeat(np.arange(size), lengths) * max(1, len(coded.dictionary)) + coded.indices.to_numpy())
    text, code = np.divmod(pairs, max(1, len(coded.dictionary)))
    frequent, log = known
    at = pc.fill_null(pc.index_in(coded.dictionary, frequent), len(log)).to_numpy()
    of, own_end = np.append(log, np.nan)[at][code], pc.index(frequent, pa.scalar(END, pa.large_binary())).as_py()
    there, end = ~np.isnan(of), log[own_end] if own_end >= 0 else 0.0
    base = np.bincount(text[there], weights=(times * of)[there], minlength=size) + end
    hits = np.bincount(text[there], weights=times[there] * (of[there] > 0), minlength=size) + (end > 0)
    others = _listed(text[~there], coded.dictionary.take(pa.array(code[~there])).cast(pa.binary()), times[~there], size)

    score, rare = np.zeros(size), []
    for key, n in _tallies(lists, np.arange(size)):
        gram, text = key >> np.uint64(8), (key & np.uint64(_TAGS - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else text  # each gram is looked up once, whatever its texts
        at = np.minimum(np.searchsorted(heavy, gram[first]), max(0, len(heavy) - 1))
        held = heavy[at] == gram[first] if len(heavy) else np.zeros(len(first), dtype=bool)
        times = np.diff(np.append(first, len(gram)))
        there = np.repeat(held, times)
        score += np.bincount(text[there], weights=n[there] * np.repeat(logs[at[held]], times[held]), minlength=size)
        rare.append((text[~there], gram[~there], n[~there]))
    text, gram, n = (np.concatenate(x) for x in zip(*rare, strict=True))
    order = _placed(text)
    grams = _listed(text[order], pa.array(gram[order].view(np.int64)), n[order], size)
    columns = [pa.array(np.arange(uid, uid + size)), batch.column(0), pa.array(lengths + 1, pa.int64()), pa.array(hits.astype(np.int64)), pa.array(base), pa.array(score), *others, *grams]
    return pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_tokens", "hits", "base", "score", "words", "words_times", "grams", "grams_times"])


def _listed(text: np.ndarray, values: pa.Array, times: np.ndarray, size: int) -> tuple[pa.Array, pa.Array]:
    """Values and times as a list each of the ``size`` texts; ``text`` is sorted."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))


def op7_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 7) == 2
    scored = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
