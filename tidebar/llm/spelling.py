"""Grouping of spelling variants (operator 11): words of a corpus that are one edit apart.

Words and their counts come from one pass over whole texts. Two words one edit apart share the first or the last half
of their letters, so a word goes to four groups: by its first and its last half, among words of its own length and the
next. A group holds a positional index of pairs of letters (2-grams); the postings of a word's rarest pairs are merged
in a heap, within the positions and lengths that one edit allows, candidates with too few pairs in common fall out, and
the rest are compared letter by letter. A group of more than LOT words is cut into lots, and every two lots meet, so no
task holds more than two of them and no pair of near words is lost. What leaves a group is one row for each word.

Defined cases: a null doc_id reads as empty, a null text has no words; repeated rows count as often as they are there; an
empty table gives an empty one. A word that is near to none has n_near 0, no form, and itself as root.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, forget, keep, only, raw_texts, small, workers_find_us

LEAST_LENGTH = 6
#: Words of a group that one index holds.
LOT = 4096
#: Words that a task counts before it hands them on.
HELD = 200_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
_OTHER = re.compile(rb"[\xC2\xC4-\xF4][\x80-\xBF]+")
_LETTERS = bytes(x | 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased runs of Latin letters of a UTF-8 text, a piece of it at a time."""
    flat = _OTHER.sub(b" ", text).translate(_LETTERS)
    start = 0
    while start < len(flat):
        end = flat.find(b" ", start + PIECE) if len(flat) - start > PIECE else -1
        end = len(flat) if end < 0 else end
        yield flat[start:end].split()
        start = end


def _altered(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _add_words(counts: Counter, doc_id: int | None, text: bytes, every: int, least: int) -> None:
    prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for words in _pieces(text):
        words = [w for w in words if len(w) >= least]
        counts.update(words)
        if every:
            for w in set(words):
                if not (h := zlib.crc32(w, prefix)) % every:
                    n = words.count(w)
                    counts[w] -= n
                    counts[_altered(w, h)] += n


def word_counts(docs: DataFrame, every: int = 199, least_n: int = 5, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: runs of Latin letters, A-Z lower-cased, of `least_length` letters and `least_n` occurrences or more.

    Where `every` divides the CRC-32 of `<doc_id>:<run>`, one letter of the run is left out first (0: nowhere).
    """
    workers_find_us(docs.sparkSession)

    def count(batches):
        counts: Counter = Counter()

        def hand_on():
            words = [(x, n) for w, n in counts.items() if n and len(x := w.decode()) >= least_length]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], schema=_COUNTS)

        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                some = batch.slice(at, 32)
                for doc_id, text in zip(some.column("doc_id").to_pylist(), raw_texts(some.column("text"))):
                    _add_words(counts, doc_id, text, every, least_length)
                    if len(counts) >= HELD:
                        yield hand_on()
        yield hand_on()

    counted = only(docs, "doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    i, end = 0, len(b)
    while i < end and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == end else a[i + 1 :] == b[i:]


class Postings:
    """Words of two adjoining lengths, filed under each pair of letters with its position.

    find() gives the filed words one edit away of which one at least has length `longest`. Of a word's own pairs at most
    two are not in such a word, so it has longest - 3 of them or more, and one of them is among the word's rarest three.
    """

    def __init__(self, longest: int):
        self.longest, self.words, self.filed = longest, [], {}

    def add(self, word: str) -> None:
        at = len(self.words)
        self.words.append(word)
        for p in range(len(word) - 1):
            self.filed.setdefault((len(word), p, word[p : p + 2]), []).append(at)

    def find(self, word: str) -> list[int]:
        n, out = len(word), []
        for length in (self.longest, self.longest - 1) if n == self.longest else (self.longest,):
            shifts = (0,) if length == n else (0, length - n)
            lists = [[x for s in shifts if (x := self.filed.get((length, p + s, word[p : p + 2])))] for p in range(n - 1)]
            lists.sort(key=lambda of: sum(map(len, of)))
            bound = self.longest - 3
            few = len(lists) - bound + 1
            rest = lists[few:]
            for at, found in groupby(heapq.merge(*(x for of in lists[:few] for x in of))):
                shared = min(few, sum(1 for _ in found))
                for k, of in enumerate(rest):
                    if shared + len(rest) - k < bound:
                        break
                    shared += any((i := bisect_left(x, at)) < len(x) and x[i] == at for x in of)
                if shared >= bound and one_edit(word, self.words[at]):
                    out.append(at)
        return out


def _meet(longest: int, side: str, lots: tuple[int, int], rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """word, number of near ones, n of the commonest, and which it is, of the near words in a group (word, n, lot).

    By their last halves only words are paired that don't share the first, so a pair is found once. Of two lots,
    words of the one look among those of the other.
    """
    half, index, best = longest // 2, Postings(longest), {}
    known: list[tuple[str, int]] = []

    def note(word: str, n: int, other: str) -> None:
        count, least = best.get(word, (0, (0, "")))
        best[word] = count + 1, min(least, (-n, other))

    apart = lots[0] != lots[1]
    if apart:
        for word, n, lot in rows:
            if lot == lots[0]:
                index.add(word)
                known.append((word, n))
    for word, n, lot in rows:
        if apart and lot == lots[0]:
            continue
        for at in index.find(word):
            other, m = known[at]
            if side == "first" or word[:half] != other[:half]:
                note(word, m, other)
                note(other, n, word)
        if not apart:
            index.add(word)
            known.append((word, n))
    for word, (count, (n, other)) in best.items():
        yield word, count, -n, other


def near_words(words: DataFrame, lot: int = LOT) -> DataFrame:
    """word, n_near, best_n, best: how many of the words are one edit away, and the commonest (ties: the least) of them.

    words: word, n; all words of a length the operator takes, each once.
    """
    halves = []
    for more in (0, 1):
        longest = F.length("word") + more
        half = F.floor(longest / 2).cast("int")
        halves += [F.struct(longest.alias("longest"), F.lit(side).alias("side"), x.alias("half")) for side, x in (("first", F.substring("word", F.lit(1), half)), ("last", F.right("word", half)))]
    placed = words.select("word", "n", F.explode(F.array(*halves)).alias("at")).select("word", "n", "at.*")
    route = ["longest", "side", "half"]
    with Scratch() as scratch:
        large = scratch.keep(placed.groupBy(*route).agg(F.count("*").alias("of")).where(F.col("of") > lot).select(*route, F.ceil(F.col("of") / lot).cast("int").alias("lots")))
        mine = F.pmod(F.xxhash64("word"), F.col("lots")).cast("int")
        placed = placed.join(small(large), route, "left").withColumn("lots", F.coalesce("lots", F.lit(1))).withColumn("lot", mine)
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        placed = placed.select(*route, F.least("lot", "other").alias("a"), F.greatest("lot", "other").alias("b"), "word", "n", "lot")
        key = [*route, "a", "b"]

        def run(batches):
            held, rows = None, []

            def done():
                out = list(_meet(held[0], held[1], (held[3], held[4]), rows)) if len(rows) > 1 else []
                return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_NEAR)], schema=_NEAR) if out else None

            for batch in batches:
                for x in zip(*(batch.column(c).to_pylist() for c in (*key, "word", "n", "lot"))):
                    if x[:5] != held:
                        if (made := done()) is not None:
                            yield made
                        held, rows = x[:5], []
                    rows.append(x[5:])
            if (made := done()) is not None:
                yield made

        found = placed.repartition(*key).sortWithinPartitions(*key, "word").mapInArrow(run, "word string, n_near long, best_n long, best string")
        best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("x")
        return keep(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.word").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (word, form; no circles) ends. Each round doubles the steps taken."""
    at = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = keep(at.select("word", "root").join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forget(at)
        if after.where("moved").isEmpty():
            return after
        at = after


def variants(docs: DataFrame, every: int = 199, least_n: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    The form of a word is the commonest word one edit away (ties: the least in code-point order), if it is `times` as
    common as the word or more.
    """
    with Scratch() as scratch:
        words = scratch.keep(word_counts(docs, every, least_n))
        near = near_words(words)
        scratch.frames.append(near)
        taken = F.col("best_n") >= times * F.col("n")
        form = [F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")]
        both = scratch.keep(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *form))
        ends = roots(both.where("form is not null"))
        scratch.frames.append(ends)
        return keep(both.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
