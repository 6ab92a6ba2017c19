"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its byte n-grams and which language's
lexicon holds it.  The lexicons are counted over all training texts; the field
is fitted on a bounded sample of them, spliced into code-switched sequences so
that transitions between languages are learned too.  Forward-backward labels
every word of a text; the text's language is the one with the largest mean
posterior.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoscan.llm.common import id_remainder, stored, table

#: The sample that the field is fitted on: texts of each language, and words of the run that is taken from a text.
SAMPLE_TEXTS, SAMPLE_WORDS = 250, 5000
#: A lexicon holds the words that are each at least this part of a language's words: so many at most.
LEXICON = 2000
HASH_BITS, MAX_GRAM = 17, 4
#: Words of a spliced sequence, of its pieces, and rounds of the fit.
SEQUENCE, PIECE, ROUNDS, RATE, DECAY = 64, (4, 32), 30, 0.5, 1e-6
UNKNOWN = "und"
#: Words of a piece of a long text.
PIECE_WORDS = 256
_WORD_SIGN = re.compile(r"[^\W\d_]")
_BLOCK_TOKENS = 1_000_000


def has_letter(text: str) -> bool:
    """Whether a character is a letter (categories L); ² and ½ are word signs, but none."""
    return any(m[0].isalpha() for m in _WORD_SIGN.finditer(text))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


class WordFeatures:
    """Hashed features of distinct words: n-grams of the word between boundary marks, which make affixes n-grams too."""

    def __init__(self, words: list[bytes], lexicon: dict[bytes, int]):
        data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), dtype=np.uint8)
        lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
        self.starts = np.cumsum(lengths) - lengths
        self.word = np.repeat(np.arange(len(words)), lengths)
        left = np.repeat(self.starts + lengths, lengths) - np.arange(len(data))  # bytes from here to the word's end
        padded = np.concatenate([data, np.zeros(MAX_GRAM, dtype=np.uint8)]).astype(np.uint64)
        self.slots, gram = [], np.zeros(len(data), dtype=np.uint64)
        for n in range(1, MAX_GRAM + 1):
            gram = (gram << np.uint64(8)) | padded[n - 1 : n - 1 + len(data)]
            mixed = (gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            self.slots.append(np.where(left >= n, (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64), 1 << HASH_BITS))  # the last slot weighs nothing
        self.lexicon = np.fromiter((lexicon.get(w, 0) for w in words), dtype=np.int64, count=len(words))

    def scores(self, weights: np.ndarray, lexicon_weights: np.ndarray) -> np.ndarray:
        return sum(np.add.reduceat(weights[s], self.starts, axis=0) for s in self.slots) + lexicon_weights[self.lexicon]


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _products(local: np.ndarray, begins: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """What each piece makes of a message that enters it: the product of its words' scores with the moves between them."""
    order = np.argsort(-lengths, kind="stable")
    begins, active = begins[order], np.searchsorted(-lengths[order], -np.arange(int(lengths.max())), side="left")
    out = local[begins][:, :, None] * np.eye(len(move))
    for t in range(1, len(active)):
        n = active[t]
        out[:n] = (out[:n] @ move) * local[begins[:n] + t][:, None, :]
        out[:n] /= out[:n].max(axis=(1, 2), keepdims=True)
    back = np.empty_like(out)
    back[order] = out
    return back


def forward_backward(scores: np.ndarray, begins: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, expect: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every word's label, and the expected transitions of all sequences (zeros unless ``expect``).

    ``scores`` has a row per word; the sequences, of any lengths but 0, take
    their steps together.  Long ones are cut into pieces of PIECE_WORDS: each
    piece is reduced to one matrix, these carry the messages from piece to
    piece, and then all pieces take their steps together.
    """
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, first = np.exp(transitions), np.exp(start)
    forward, back = np.zeros_like(local), np.ones_like(local)
    expected = np.zeros_like(move)
    if not len(lengths):
        return forward, expected
    many = -(-lengths // PIECE_WORDS)
    heads = np.cumsum(many) - many
    nth = np.arange(many.sum()) - np.repeat(heads, many)
    piece = np.repeat(begins, many) + nth * PIECE_WORDS
    size = np.minimum(PIECE_WORDS, np.repeat(lengths, many) - nth * PIECE_WORDS)
    entering, leaving = np.where((nth == 0)[:, None], first, 0.0), np.ones((len(piece), len(move)))
    if len(piece) > len(lengths):
        cut = np.repeat(many > 1, many)
        matrix = np.zeros((len(piece), *move.shape))
        matrix[cut] = _products(local, piece[cut], size[cut], move)
        order = np.argsort(-many, kind="stable")
        tops, active = heads[order], np.searchsorted(-many[order], -np.arange(int(many.max())), side="left")
        for j in range(1, len(active)):
            at = tops[: active[j]] + j
            entering[at] = _normal(_normal((entering[at - 1][:, None, :] @ matrix[at - 1])[:, 0]) @ move)
        for j in range(len(active) - 1, 0, -1):
            at = tops[: active[j]] + j
            leaving[at - 1] = _normal(_normal((matrix[at] @ leaving[at][:, :, None])[:, :, 0]) @ move.T)
    order = np.argsort(-size, kind="stable")
    piece, entering, leaving = piece[order], entering[order], leaving[order]
    active = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left")  # pieces longer than t
    for t in range(len(active)):
        at = piece[: active[t]] + t
        forward[at] = _normal((entering if t == 0 else forward[at - 1] @ move) * local[at])
    for t in range(len(active) - 1, -1, -1):
        n = active[t + 1] if t + 1 < len(active) else 0
        ahead = piece[:n] + t + 1
        back[ahead - 1] = _normal((local[ahead] * back[ahead]) @ move.T)
        back[piece[n : active[t]] + t] = leaving[n : active[t]]
    if expect:
        inner = np.ones(len(local), dtype=bool)
        inner[begins] = False
        ahead = np.flatnonzero(inner)
        for k in range(0, len(ahead), 1 << 16):
            at = ahead[k : k + (1 << 16)]
            pair = forward[at - 1][:, :, None] * move * (local[at] * back[at])[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return _normal(forward * back), expected


class LanguageField:
    """The fitted field; ``languages`` in order of their labels."""

    def __init__(self, languages: list[str], lexicon: dict[bytes, int]):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights, self.lexicon_weights = np.zeros(((1 << HASH_BITS) + 1, n)), np.zeros((n + 1, n))
        self.transitions, self.start = np.zeros((n, n)), np.zeros(n)

    def fit(self, texts: list[tuple[int, list[bytes]]], seed: int = 5) -> LanguageField:
        """Maximise the likelihood of spliced sequences by scaled gradient steps."""
        n, rng = len(self.languages), np.random.Generator(np.random.PCG64(seed))
        pieces = []
        for label, words in texts:
            at = 0
            while at < len(words):
                size = int(rng.integers(*PIECE))
                pieces.append((label, words[at : at + size]))
                at += size
        tokens = [(w, label) for i in rng.permutation(len(pieces)) for label, ws in [pieces[i]] for w in ws]
        if not tokens:
            return self
        ids: dict[bytes, int] = {}
        word = np.fromiter((ids.setdefault(w, len(ids)) for w, _ in tokens), dtype=np.int64, count=len(tokens))
        label = np.fromiter((y for _, y in tokens), dtype=np.int64, count=len(tokens))
        begins = np.arange(0, len(tokens), SEQUENCE)
        lengths = np.minimum(SEQUENCE, len(tokens) - begins)
        known = WordFeatures(list(ids), self.lexicon)
        inner = np.ones(len(tokens), dtype=bool)
        inner[begins] = False
        seen = np.zeros((n, n))
        np.add.at(seen, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
        truth = np.eye(n)[label]
        squares = [np.full_like(x, 1e-8) for x in (self.weights, self.lexicon_weights, self.transitions, self.start)]
        for _ in range(ROUNDS):
            posterior, expected = forward_backward(known.scores(self.weights, self.lexicon_weights)[word], begins, lengths, self.transitions, self.start)
            gap = (truth - posterior) / len(tokens)
            by_word = np.stack([np.bincount(word, weights=gap[:, k], minlength=len(ids)) for k in range(n)], axis=1)
            steps = [np.zeros_like(self.weights), np.zeros_like(self.lexicon_weights), (seen - expected) / len(tokens), gap[begins].sum(axis=0)]
            for slots in known.slots:
                for k in range(n):
                    steps[0][:, k] += np.bincount(slots, weights=by_word[known.word, k], minlength=len(self.weights))
            np.add.at(steps[1], known.lexicon, by_word)
            for x, g, s in zip((self.weights, self.lexicon_weights, self.transitions, self.start), steps, squares, strict=True):
                g -= DECAY * x
                s += g * g
                x += RATE * g / np.sqrt(s)
            self.weights[-1] = 0
        return self

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each whole text has, and the posterior of every word, text after text."""
        ids: dict[bytes, int] = {}
        split = [words_of(t) if t and has_letter(t) else [] for t in texts]
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        word = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), dtype=np.int64, count=int(lengths.sum()))
        if not self.languages or not len(word):
            return np.zeros_like(lengths), np.zeros((0, len(self.languages)))
        distinct = list(ids)
        scores = np.vstack([WordFeatures(distinct[k : k + 50_000], self.lexicon).scores(self.weights, self.lexicon_weights) for k in range(0, len(distinct), 50_000)])
        there = np.flatnonzero(lengths)
        return lengths, forward_backward(scores[word], (np.cumsum(lengths) - lengths)[there], lengths[there], self.transitions, self.start, expect=False)[0]

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and mean posterior of each whole text."""
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
        lengths, posterior = self.posteriors(texts)
        there = np.flatnonzero(lengths)
        if len(there):
            mean = np.add.reduceat(posterior, (np.cumsum(lengths) - lengths)[there], axis=0) / lengths[there, None]
            for i, k, p in zip(there.tolist(), mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist(), strict=True):
                names[i], best[i] = self.languages[k], min(1.0, p)
        return names, best

    def label_words(self, text: str | None) -> list[tuple[bytes, str]]:
        """Each word of a text with its own most likely language: where code-switched texts switch."""
        _, posterior = self.posteriors([text])
        return [(w, self.languages[k]) for w, k in zip(words_of(text), posterior.argmax(axis=1).tolist(), strict=False)] if len(posterior) else []


def lexicon_words(training: DataFrame, size: int = LEXICON) -> DataFrame:
    """lang, word, share: the words that make up at least 1 / size of their language's words in ``training`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    counts = stored(training.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lexicon-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") * size >= 1).select("lang", "word", "share")


def fit_field(training: DataFrame) -> LanguageField:
    """The field of ``training`` (doc_id, lang, text), lang not null."""
    lexicon: dict[bytes, tuple[float, str]] = {}
    rows = lexicon_words(training.select("lang", "text")).collect()  # LEXICON words a language at most
    for r in sorted(rows, key=lambda r: (r.share, r.lang)):
        lexicon[bytes(r.word)] = (r.share, r.lang)  # the language where it is most frequent comes last
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = training.join(F.broadcast(training.groupBy("lang").count()), "lang").where(draw * F.col("count") <= 2 * SAMPLE_TEXTS)  # few texts are moved
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    words = F.split("text", r"\s+")
    run = F.slice(words, F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.size(words) - SAMPLE_WORDS, F.lit(0)) + 1).cast("int") + 1, SAMPLE_WORDS)  # from anywhere in a long text
    taken = drawn.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= SAMPLE_TEXTS).select("lang", "turn", F.array_join(run, " ").alias("text"))
    sample = sorted(tuple(r) for r in taken.collect())  # SAMPLE_TEXTS a language at most, SAMPLE_WORDS words each
    languages = sorted({r[0] for r in sample} | {lang for _, lang in lexicon.values()})
    number = {lang: k for k, lang in enumerate(languages)}
    field = LanguageField(languages, {w: 1 + number[lang] for w, (_, lang) in lexicon.items()})
    return field.fit([(number[lang], words_of(text)) for lang, _, text in sample])


def identify(docs: DataFrame, is_training: Column) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text, lang).

    Learned from text and lang of the rows that satisfy ``is_training`` (a
    condition on doc_id) and whose lang is not null; predictions read the text
    only.  A null text, or one without letters, is ``und`` with score 0, and so
    is every text if nothing could be learned.  Repeated rows are labelled
    each.  Extra columns are ignored.
    """
    training = docs.where(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit_field(training))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo = batch.column(1).to_pylist(), 0
            while lo < len(texts):
                hi, room = lo, 6 * _BLOCK_TOKENS
                while hi < len(texts) and (hi == lo or room >= len(texts[hi] or "")):
                    room -= len(texts[hi] or "")
                    hi += 1
                names, score = shared.value.label(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(label, "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
