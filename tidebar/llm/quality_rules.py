"""Quality rules (operator 5): plain rules on words and lines, and a hashed n-gram log-likelihood ratio.

Byte n-grams are hashed into a fixed number of buckets. Bucket counts over all documents and over trusted ones give
two multinomials; a document's verdict is its mean log ratio of the two against a fixed threshold, so every
document is judged by the same rule whatever its length. The model is two vectors of a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_batch, grams, only, raw_texts, sum_blobs

BUCKETS = 1 << 16
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Trusted ids that are broadcast at once; with more there are several passes, so that texts are never shuffled.
SLICE = 2_000_000
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("llr", pa.float64())]
)


def buckets(text: bytes) -> np.ndarray:
    """Bucket of each run of four bytes."""
    b = np.frombuffer(text, dtype=np.uint8)
    if len(b) < 4:
        return np.empty(0, dtype=np.uint32)
    code = b[:-3].astype(np.uint32)
    for i in range(1, 4):
        code |= b[i : len(b) - 3 + i].astype(np.uint32) << np.uint32(8 * i)
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def base_rules(text: str, raw: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    repeat = 0
    if len(words) >= WINDOW:
        g = grams(hashes.of(words), WINDOW)
        order = np.argsort(g, kind="stable")
        same = g[order[1:]] == g[order[:-1]]
        if same.any():
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            repeat = int((np.cumsum(cover) > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids marked good and not toxic, each once."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame | list[int], shrink: float = 0.1) -> np.ndarray:
    """log(P_trusted / P_corpus) of each bucket. The counts are over all trusted and over all documents.

    P_trusted is shrunk towards P_corpus by a share, so that no ratio is below log(shrink) at any size of the input.
    """
    if not isinstance(trusted, DataFrame):
        trusted = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(trusted))], "doc_id long")
    texts, slices = only(docs, "doc_id", "text"), max(1, math.ceil(trusted.count() / SLICE))
    ids = trusted.select("doc_id", F.lit(True).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, BUCKETS))
        for batch in batches:
            good = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False)
            texts = raw_texts(batch.column(1))
            for pick, row in ((good, 0), (~good, 1)):
                for at in range(0, len(texts), 64):  # joined, as one count for many texts is faster
                    part = [buckets(texts[i]) for i in range(at, min(at + 64, len(texts))) if pick[i]]
                    if part:
                        acc[row] += np.bincount(np.concatenate(part), minlength=BUCKETS)
        acc[1] += acc[0]
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], type=pa.binary())], ["blob"])

    good, corpus = np.zeros((2, BUCKETS))
    for i in range(slices):  # the first pass counts all texts, the others those of their own slice
        part = F.broadcast(ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == i))
        flagged = texts.join(part, "doc_id", "inner" if i else "left").select("good", "text")
        some, whole = sum_blobs(flagged.mapInArrow(count, "blob binary"), 2 * BUCKETS).reshape(2, BUCKETS)
        good += some
        corpus = corpus if i else whole
    if not good.sum():
        return np.zeros(BUCKETS, dtype=np.float32)
    q = np.maximum(corpus, 1e-3) / corpus.sum()
    p = (1 - shrink) * good / good.sum() + shrink * q
    return np.log(p / q).astype(np.float32)


def judge(docs: DataFrame, trusted: DataFrame | list[int], threshold: float = -0.35) -> DataFrame:
    """Base rules and verdict of every whole text; trusted are doc_ids, each once if in a table.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr. Kept are
    documents that pass the base rules and whose mean log ratio reaches `threshold`; texts with no n-gram have the
    ratio 0. A null text has no words and fails; a null doc_id stays null and is never trusted; repeated rows are
    judged (and counted) once each; other columns are ignored; an empty table gives no rows.
    """
    ratios = log_ratios(docs, trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                raw = text.encode()
                base = base_rules(text, raw, hashes)
                failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
                at = buckets(raw)
                llr = float(ratios[at].mean(dtype=np.float64)) if len(at) else 0.0
                rows.append((doc, *base, failed, not failed and llr >= threshold, llr))
            columns = list(zip(*rows)) or [()] * len(SCHEMA)
            yield as_batch(SCHEMA, **dict(zip(SCHEMA.names, map(list, columns))))

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double")
