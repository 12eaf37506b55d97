"""Quality classifier (operator 3): random Fourier features, ridge by normal equations, isotonic calibration.

A document is read once, into a few statistics of its text. On the labelled rows that may be learned from,
partitions sum the normal equations of a ridge fit on random Fourier features (an approximate Gaussian kernel) of
these statistics; what reaches the driver is one matrix of fixed size. Scores are then calibrated by isotonic
regression on a histogram of fixed width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, frugal, grams, keep, only, raw_texts, sum_blobs

STATS = ("log_words", "word_len", "word_len_sd", "distinct", "top_word", "repeats_next", "dup_lines", "line_words", "dup_grams", "upper", "lower", "digit", "mark", "symbol", "bang", "high", "capital_words")
CLASSES = np.full(256, 5, dtype=np.uint8)  # other ASCII marks
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[65:91] = 1
CLASSES[97:123] = 2
CLASSES[48:58] = 3
CLASSES[[ord(c) for c in "#*$%&|<>"]] = 4
CLASSES[[ord(c) for c in "!?"]] = 6
CLASSES[128:] = 7


def statistics(text: bytes, hashes: WordHashes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    kinds = np.bincount(CLASSES[np.frombuffer(text, dtype=np.uint8)], minlength=8)
    chars = max(1, len(text) - int(kinds[0]))
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    h = hashes.of(words)
    ordered = np.sort(h)
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    runs = np.diff(edges)
    g = np.sort(grams(h, 4))
    lines = [x for x in text.split(b"\n") if x.strip()]
    firsts = np.fromiter((65 <= w[0] <= 90 for w in words), dtype=bool, count=n)
    return [
        float(np.log1p(n)),
        float(lens.mean()),
        float(lens.std()),
        len(runs) / n**0.85,
        float(runs.max()) / n,
        float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        float((g[1:] == g[:-1]).mean()) if len(g) > 1 else 0.0,
        *(float(kinds[k]) / chars for k in range(1, 8)),
        float(firsts.mean()),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats, an array of the statistics of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            stats = [statistics(t, hashes) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, type=pa.list_(pa.float64()))], ["doc_id", "stats"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the random Fourier features' frequencies, (statistics, features)
    phases: np.ndarray
    ridge: np.ndarray
    edges: np.ndarray  # raw scores and what they are calibrated to
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.weights + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, z / 6, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing least-squares fit by pooling adjacent violators; x is sorted."""
    blocks: list[list[float]] = []
    for v, k in zip(y, w):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([[v] * int(n) for v, _, n in blocks])


def _stacked(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return np.asarray(values.flatten()).reshape(len(values), len(STATS))


def fit(examples: DataFrame, features: int = 256, bandwidth: float = 3.0, penalty: float = 1e-2, bins: int = 2048, seed: int = 5) -> Model:
    """Fit on all rows of examples (stats, label 0 or 1). Without examples every score is one half."""
    k = len(STATS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(2 * k + 1)
        for batch in batches:
            x = _stacked(batch, "stats")
            acc += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], type=pa.binary())], ["blob"])

    got = sum_blobs(examples.mapInArrow(moments, "blob binary"), 2 * k + 1)
    n = max(1.0, got[-1])
    mean = got[:k] / n
    scale = np.sqrt(np.maximum(got[k : 2 * k] / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(k, features)) / bandwidth, rng.uniform(0, 2 * np.pi, features), np.zeros(features + k + 1), np.array([0.0]), np.array([0.5]))
    if not got[-1]:
        return model
    d = features + k + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((d, d + 1))
        for batch in batches:
            z, y = model.features(_stacked(batch, "stats")), np.asarray(batch.column("label"), dtype=np.float64)
            acc += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], type=pa.binary())], ["blob"])

    both = sum_blobs(examples.mapInArrow(equations, "blob binary"), d * (d + 1)).reshape(d, d + 1)
    model.ridge = np.linalg.solve(both[:, :d] + penalty * np.eye(d), both[:, d])
    low, high = -0.5, 1.5

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, bins))
        for batch in batches:
            at = np.clip((model.raw(_stacked(batch, "stats")) - low) / (high - low) * bins, 0, bins - 1).astype(np.int64)
            y = np.asarray(batch.column("label"), dtype=np.float64)
            acc += np.stack([np.bincount(at, minlength=bins), np.bincount(at, weights=y, minlength=bins)])
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], type=pa.binary())], ["blob"])

    count, ones = sum_blobs(examples.mapInArrow(histogram, "blob binary"), 2 * bins).reshape(2, bins)
    at = np.flatnonzero(count)
    model.edges = low + (at + 0.5) * (high - low) / bins
    model.levels = isotonic(model.edges, ones[at] / count[at], count[at])
    return model


def _held_out(folds: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(stats: DataFrame, labels: DataFrame, folds: int) -> Model:
    """Fit on the labelled rows of stats that aren't held out."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    return fit(keep(stats.where(~_held_out(folds)).join(marks, "doc_id").select("stats", "label")))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    labels has doc_id and quality (0 or 1). Learned from: labelled rows whose crc32(doc_id as text) isn't
    divisible by `folds`; a doc_id with several labels counts as their smallest, null labels and ids as none.
    Scores come from the text alone. A null text is an empty one and gets the score of an empty text; a null doc_id
    stays null and isn't held out; repeated rows are scored once each; other columns are ignored; an empty table
    gives no rows.
    """
    stats = keep(document_statistics(docs))
    model = learn(stats, labels, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_stacked(batch, "stats"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.withColumn("held_out", _held_out(folds)).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Rows of docs, all columns, that classify() would predict as 1; judged where they are read, without a shuffle of texts.

    What classify() says of labels, nulls, empty texts, repeated rows, clashing names and empty tables holds here too.
    """
    model = learn(document_statistics(docs), labels, folds)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            if batch.num_rows:
                stats = np.array([statistics(t, hashes) for t in raw_texts(batch.column(place))])
                yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(frugal(run), docs.schema)
