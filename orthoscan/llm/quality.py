"""Quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over the statistics
(Rahimi, Recht 2007).  Ridge scores come from normal equations that every
partition of labelled rows sums for itself; the sums of squares have a fixed
size, whatever the corpus.  Isotonic regression turns ridge scores into
probabilities (pool adjacent violators over score bins).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.llm.common import arrow_rows, freed, id_remainder, stored, table, text_slices

FEATURES, SEED = 256, 11
#: Width of the kernel in standardised statistics, and weight of the ridge.
GAMMA, RIDGE = 0.05, 1e-3
#: Labelled rows that the model is fitted on, about; and partitions that sum their normal equations, at most.
FIT_ROWS, SUM_PARTS = 2_000_000, 64
#: Score bins of the calibration, per unit of score.
BINS = 500
THRESHOLD = 0.7
STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "digit", "mark", "bang", "bar", "other_ascii", "non_ascii",
    "marked_words", "upper_words", "repeats", "distinct", "top_share", "log_lines", "line_length", "short_lines", "repeated_lines", "stop_like",
)
_CLASS = np.full(256, 4, dtype=np.int64)  # of a byte: 0 lower, 1 upper, 2 digit, 3 white space, 4 other, 5-7 marks, 8 not ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 0, 1, 2, 3, 8
_CLASS[[ord(c) for c in "*&%$#@^~<>{}[]\\=+_"]], _CLASS[ord("!")], _CLASS[ord("|")] = 5, 6, 7


def statistics(text: str | None) -> list[float]:
    """STATISTICS of the whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    size = max(1, len(data))
    share = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=9) / size
    words = data.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = data.split(b"\n")
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = sum(w[-1] in b"*&%$#@!^~|" for w in words)
    return [
        np.log1p(len(words)), lengths.mean(), lengths.std(), share[1], share[2], share[5], share[6], share[7], share[4], share[8],
        marked / n, sum(w.isupper() for w in words) / n, repeats / n, len(counts) / n, max(counts.values(), default=0) / n,
        np.log1p(len(lines)), np.log1p(size / len(lines)), sum(len(x) < 20 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
        sum(c for w, c in counts.items() if len(w) <= 4) / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats array<double> of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in text_slices(b, 1)):
            stats = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(measure), "doc_id long, stats array<double>")


class KernelRidge:
    """Standardise, project to random features, weigh, calibrate."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, gamma: float = GAMMA, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.std = mean, std
        self.directions = rng.normal(0, np.sqrt(2 * gamma), (len(mean), features))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.levels = np.zeros(1), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant, one row per document."""
        z = np.clip((stats - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit to ``y`` in the order given (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for value, w in zip(y.tolist(), weight.tolist(), strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def _arrays(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(name)
    return col.flatten().to_numpy().reshape(len(col), -1)


def fit(labelled: DataFrame) -> KernelRidge | None:
    """The model of ``labelled`` (stats array<double>, label 0/1), or None without rows."""
    dims = range(len(STATISTICS))
    sums = labelled.agg(F.count("*"), *[f(F.get("stats", i)) for i in dims for f in (F.avg, F.stddev_pop)]).first()
    if not sums[0]:
        return None
    mean, std = np.array(sums[1::2], dtype=float), np.array(sums[2::2], dtype=float)
    model = KernelRidge(mean, np.where(std > 1e-9, std, 1.0))
    parts = labelled.coalesce(SUM_PARTS)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            stats, label = _arrays(batch, "stats"), batch.column("label").to_numpy().astype(float)
            for k in range(0, len(label), 4096):
                x = model.features(stats[k : k + 4096])
                total[:, :-1] += x.T @ x
                total[:, -1] += x.T @ label[k : k + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    partial = parts.mapInArrow(normal, "row long, sums array<double>").toArrow()  # SUM_PARTS tables of fixed size
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    np.add.at(total, partial.column("row").to_numpy(), partial.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES + 2))
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * sums[0] * np.eye(FEATURES + 1) * (np.arange(FEATURES + 1) < FEATURES)[:, None], total[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.round(model.raw(_arrays(batch, "stats")) * BINS).astype(np.int64)), batch.column("label").cast(pa.int64())], ["bin", "label"])

    bins = parts.mapInArrow(raw, "bin long, label long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").toArrow()  # as many bins as BINS times the range of scores
    n, ones = bins.column("n").to_numpy().astype(float), bins.column("ones").to_numpy().astype(float)
    model.knots, model.levels = bins.column("bin").to_numpy() / BINS, isotonic(bins.column("bin").to_numpy(), ones / n, n)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, is_training: Column, key: str = "quality", unfitted: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) of every row of ``docs``.

    Learned from the rows of ``docs`` that satisfy ``is_training`` (a condition
    on doc_id) and have a non-null label in ``labels`` (doc_id and ``key``).
    Only the text goes into a score; null and empty texts are scored by their
    statistics, which are those of an empty text.  Repeated rows are scored
    each; repeated labels count each.  Without any labelled row every score is
    ``unfitted``.  Extra columns are ignored.
    """
    with arrow_rows(docs.sparkSession):
        measured = stored(document_statistics(docs), "quality-statistics")
    marks = labels.select("doc_id", F.col(key).cast("int").alias("label")).where(F.col("label").isNotNull())
    labelled = stored(measured.where(is_training).join(marks, "doc_id").select("doc_id", "stats", "label"), "quality-labelled")
    part = min(1.0, FIT_ROWS / max(1, labelled.count()))
    model = fit(labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(_arrays(batch, "stats")) if shared.value else np.full(len(batch), unfitted)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return measured.mapInArrow(score, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, is_training: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``; all columns pass through.

    Rows that share a doc_id are kept or lost together, by their best score;
    rows with a null doc_id likewise.  Without any labelled row no model can be
    fitted, and every document is kept.
    """
    scores = quality_scores(docs, labels, is_training, unfitted=1.0)
    bad = stored(scores.groupBy("doc_id").agg(F.max("score").alias("best")).where(F.col("best") < threshold).select(F.col("doc_id").alias("rejected")), "quality-rejected")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["rejected"]), "left_anti")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
