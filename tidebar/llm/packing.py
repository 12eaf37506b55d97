"""Packing of tokenised documents into fixed-length sequences (operator 2).

Shortest-pack-first over the length histogram: a document's full windows of `size` ids are sequences by
themselves; the rest of each document is one piece shorter than `size`. Only the histogram of these lengths,
at most `size` numbers, comes to the driver. There lengths are placed longest first, each into the pack pattern
with the most room, and pattern counts are updated; patterns are then joined back to the pieces by rank among
the pieces of their length. Work on the driver depends on `size` alone.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from .common import keep, only

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECE_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
#: Pieces of a length that are ranked in one task at about the most: common lengths are cut into as many salts as it takes.
RANKED = 50_000


class Remembered(dict):
    """A dict of two generations: when the young one is full it becomes the old one, and what is asked for comes back."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


def _gather(ids: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that lie behind one another in ids: the wanted runs, behind one another too, and their lengths."""
    starts, n = np.cumsum(lengths) - lengths, lengths[which]
    shift = starts[which] - (np.cumsum(n) - n)
    return ids[np.repeat(shift, n) + np.arange(n.sum())], n


class WordTokenizer:
    """ids of whole texts by `tokenizers`, each distinct word encoded once while it is remembered.

    Valid for a tokenizer that lower-cases, whose pre-tokenizer drops white space, never joins what white space
    separates and keeps letters together, and whose words end in ids with the end-of-word suffix. In texts of Latin-1
    letters, words with at most one full stop or comma behind them are encoded many at a time, without the normalizer
    that their lower case has no use for; every other stretch between spaces, and every stretch of other texts, is
    encoded by itself. Words are told apart in Arrow, so Python sees each once for a lot of texts.
    """

    #: Characters of the texts that are worked on at once, but for longer texts.
    LOT = 4_000_000

    def __init__(self, path: str, limit: int = 450_000):
        self.tokenizer, self.of_letters = (Tokenizer.from_file(path) for _ in range(2))
        for t in (self.tokenizer, self.of_letters):
            t.no_padding()
            t.no_truncation()
        self.of_letters.normalizer = None
        self.of_letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.words = Remembered(limit)
        self.marks = self._each(["", ".", ","])

    def _each(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """ids of words of Latin-1 letters in lower case."""
        out: list[bytes] = []
        for i in range(0, len(words), 200):
            part = words[i : i + 200]
            ids = np.array(self.of_letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(part):
                raise ValueError("the tokenizer doesn't end each word with its suffix")
            raw, at = ids.tobytes(), 0
            for end in cuts.tolist():
                out.append(raw[at:end])
                at = end
        return out

    def _of_words(self, words: list[str], letters: list[bool]) -> list[bytes]:
        """ids of distinct words, from memory where they are there; letters tells which are Latin-1 letters in lower case."""
        out = list(map(self.words.get, words))
        gaps = [i for i, x in enumerate(out) if x is None]
        old = self.words.old.get
        again, split, rest = {}, [], []
        for i in gaps:
            known = old(words[i])
            if known is not None:
                again[words[i]] = out[i] = known
            else:
                (split if letters[i] else rest).append(i)
        for i, ids in zip(split, self._letters([words[i] for i in split])):
            again[words[i]] = out[i] = ids
        for k in range(0, len(rest), 1000):
            for i, ids in zip(rest[k : k + 1000], self._each([words[i] for i in rest[k : k + 1000]])):
                out[i] = ids
                if len(words[i]) < 100:  # longer ones are used once, not remembered
                    again[words[i]] = ids
        self.words.turn()
        self.words.update(again)
        return out

    def _lot(self, texts: list[str], plain: bool) -> list[bytes]:
        split = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], type=pa.large_string()), " ")
        stretches = split.flatten().dictionary_encode()
        words = stretches.dictionary
        if plain:
            mark = pc.if_else(pc.ends_with(words, "."), 1, pc.if_else(pc.ends_with(words, ","), 2, 0))
            core = pc.if_else(pc.greater(mark, 0), pc.utf8_slice_codeunits(words, 0, -1), words)
            letters = pc.and_(pc.utf8_is_alpha(core), pc.less(pc.utf8_length(core), 100))
            marks = pc.if_else(letters, mark, 0).to_numpy(zero_copy_only=False)
            words = pc.if_else(letters, core, words).dictionary_encode()
            which, words = words.indices.to_numpy(), words.dictionary
            letters = pc.and_(pc.utf8_is_alpha(words), pc.less(pc.utf8_length(words), 100)).to_numpy(zero_copy_only=False)
        else:
            marks, which, letters = np.zeros(len(words), np.int64), np.arange(len(words)), np.zeros(len(words), dtype=bool)
        parts = self.marks + self._of_words(words.to_numpy(zero_copy_only=False).tolist(), letters.tolist())
        ids, lengths = np.frombuffer(b"".join(parts), dtype="<u4"), np.array([len(x) // 4 for x in parts])
        # A stretch is a word and its mark; a text is its stretches.
        ids, n = _gather(ids, lengths, np.stack([which + len(self.marks), marks], axis=1).ravel())
        ids, n = _gather(ids, n.reshape(-1, 2).sum(axis=1), stretches.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(n)])[split.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        lots: dict[bool, list[tuple[int, str]]] = {True: [], False: []}
        held = {True: 0, False: 0}

        def work(plain: bool) -> None:
            if lots[plain]:
                for (i, _), ids in zip(lots[plain], self._lot([t for _, t in lots[plain]], plain)):
                    out[i] = ids
                lots[plain], held[plain] = [], 0

        for i, text in enumerate(texts):
            plain = False
            if "<|" not in text:  # not to turn anything into a special token
                try:
                    text.encode("latin-1")
                    text, plain = text.lower(), True
                except UnicodeEncodeError:
                    pass
            if held[plain] + len(text) > self.LOT:
                work(plain)
            lots[plain].append((i, text))
            held[plain] += len(text)
        work(True)
        work(False)
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def _pieces(tokenizer_path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        tok = _tokenizers[tokenizer_path]
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), tok.ids([t or "" for t in batch.column(1).to_pylist()])):
                view = memoryview(raw + end)
                n = len(view) // 4
                for s in range(0, n, size):
                    part = view[4 * s : 4 * (s + size)]
                    rows.append((doc, s, len(part) // 4, zlib.crc32(part), n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], schema=PIECE_SCHEMA)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int) -> DataFrame:
    """Each document's ids, and `end_id` behind them, cut into pieces of at most `size` ids."""
    return only(docs, "doc_id", "text").mapInArrow(_pieces(tokenizer_path, size, end_id), PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(number of packs, {length: pieces of that length in each}) for all pieces of the histogram.

    Longest lengths first; pieces go one each to the packs that have the most room, and where no pack has room,
    to new packs as full of that length as they get.
    """
    done: list[tuple[int, dict[int, int]]] = []
    rooms: list[int] = []  # sorted
    packs: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def put(room: int, count: int, pattern: dict[int, int]) -> None:
        if room == 0:
            done.append((count, pattern))
            return
        if room not in packs:
            packs[room] = []
            bisect.insort(rooms, room)
        packs[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                count, pattern = packs[room].pop()
                if not packs[room]:
                    del packs[room]
                    rooms.pop()
                # Worst fit would come back to this pack for as long as it still has the most room.
                next_room = rooms[-1] if rooms else 0
                each = max(1, min(room // length, (room - next_room) // length, left // count))
                used = min(count, left // each)
                if used < count:
                    put(room, count - used, pattern)
                if used:
                    put(room - each * length, used, {**pattern, length: pattern.get(length, 0) + each})
                left -= used * each
            else:
                each = size // length
                full, rest = divmod(left, each)
                for count, n in ((full, each), (1, rest)):
                    if count and n:
                        put(size - n * length, count, {length: n})
                left = 0
    return done + [p for room in rooms for p in packs[room]]


def _place(ranges: dict[int, tuple], size: int, columns: pa.Schema):
    """Sequence and offset of each piece, from its rank among the pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                starts, each, first_pack, first_offset = ranges[int(n)]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                inner = rank[at] - starts[k]
                seq[at] = first_pack[k] + inner // each[k]
                off[at] = first_offset[k] + inner % each[k] * n
            arrays = [batch.column(c) for c in PIECE_SCHEMA.names] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(arrays, schema=columns)

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack all documents into sequences of at most `size` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text is an
    empty one (its only id is `end_id`); a null doc_id is kept as null; repeated rows are packed once each; other
    columns are ignored; an empty table gives no rows. Sequences hold their pieces without gaps.
    """
    pieces = keep(token_pieces(docs, tokenizer_path, size, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a number for each length
    salts = F.array(*[F.lit(math.ceil(histogram.get(n, 0) / RANKED) or 1) for n in range(1, size + 1)])
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(salts, F.col("length").cast("int")))
    counts = pieces.groupBy("length", salt.alias("salt")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))

    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    used = dict.fromkeys(histogram, 0)
    packs = 0
    for count, pattern in shortest_pack_first(histogram, size):
        offset = 0
        for length, each in pattern.items():
            ranges.setdefault(length, []).append((used[length], each, packs, offset))
            used[length] += count * each
            offset += length * each
        packs += count
    lookup = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for n, v in ranges.items()}

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("salt", salt)
        .withColumn("within", F.row_number().over(order) - 1)
        .join(counts.select("length", "salt", "base"), ["length", "salt"])
        .select(*PIECE_SCHEMA.names, (F.col("base") + F.col("within")).cast("long").alias("rank"))
    )
    out = pa.schema([*PIECE_SCHEMA, pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])
    return ranked.mapInArrow(_place(lookup, size, out), PIECES + ", sequence_id long, offset long")
