"""Token counts by trie-shared dynamic programming over a unigram vocabulary (operator 10).

A worker keeps a trie of the pre-tokens it has met: a node for each prefix, with the forward score of its best
segmentation, and terminal counts where a pre-token ends. Distinct pre-tokens of a slice that have no terminal are
inserted in sorted order, which walks the trie depth first: scores on the path from the root are at hand, and a node's
score is computed once for all pre-tokens below it, whichever slice or task of the worker brings them. Terminal counts
are summed over each document's pre-tokens.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_batch, only, raw_texts

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])
Vocabulary = dict[bytes, int]


def zipf_vocabulary(path: str) -> Vocabulary:
    """Pieces of a rank file with scores -log(rank + 1), in whole millionths so that sums are exact."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return {piece: -round(1e6 * math.log(rank + 1)) for piece, rank in ranks.items()}


#: A score carries the number of pieces in its low bits, so that the larger of two has the higher sum, then fewer pieces.
SHIFT = 32


class TrieCounter:
    """Number of pieces in the best segmentation of a pre-token: highest score, then fewest pieces.

    The trie holds `limit` nodes at the most, none deeper than `deepest` bytes; when it is full it begins anew. What
    lies deeper is computed on the path and forgotten, so long pre-tokens cost time alone.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = 250_000, deepest: int = 48):
        self.limit, self.deepest = limit, deepest
        self.nodes: dict[bytes, int | None] = {}
        self.terminals: dict[bytes, int] = {}
        self.worth = {piece: (score << SHIFT) - 1 for piece, score in vocabulary.items()}
        #: lengths of pieces by their last byte, and of those two and more bytes long by their last two
        lengths: dict[bytes, set[int]] = {}
        for piece in vocabulary:
            lengths.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {end: sorted(n) for end, n in lengths.items()}

    def learn(self, words: list[bytes]) -> dict[bytes, int]:
        """Counts of sorted distinct pre-tokens."""
        path: list[int | None] = [0]
        worth, lengths, nodes, deepest, before, out = self.worth, self.lengths, self.nodes, self.deepest, b"", {}
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if end <= deepest:
                    prefix = word[:end]
                    if prefix in nodes:
                        path.append(nodes[prefix])
                        continue
                best = worth.get(word[end - 1 : end])
                if best is not None:
                    best = None if path[end - 1] is None else best + path[end - 1]
                if end > 1:
                    for n in lengths.get(word[end - 2 : end], ()):
                        if n > end:
                            break
                        s = worth.get(word[end - n : end])
                        if s is not None and path[end - n] is not None:
                            s += path[end - n]
                            if best is None or s > best:
                                best = s
                path.append(best)
                if end <= deepest:
                    nodes[prefix] = best
            if path[-1] is None:
                raise ValueError("the vocabulary lacks a byte")
            out[word] = -path[-1] & ((1 << SHIFT) - 1)
            before = word
        return out

    def documents(self, split: list[list[bytes]]) -> list[int]:
        """Number of pieces of each document, given as its pre-tokens."""
        if len(self.nodes) > self.limit:
            self.nodes.clear()
            self.terminals.clear()
        new = set(chain.from_iterable(split)) - self.terminals.keys()
        counts = self.learn(sorted(new))
        deep = {w: counts.pop(w) for w in new if len(w) > self.deepest}
        self.terminals.update(counts)
        get = self.terminals.__getitem__ if not deep else lambda w: deep[w] if w in deep else self.terminals[w]
        return [sum(map(get, words)) for words in split]


_counters: dict[str, TrieCounter] = {}


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text.

    Pre-tokens are `[^\\x20\\x09-\\x0D]+`, as UTF-8 behind one space byte. Null and empty texts have none; a null
    doc_id stays null; repeated rows are counted once each; other columns are ignored; an empty table gives no
    rows. Documents are counted where they are read: no shuffle, and a trie of bounded size for a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path not in _counters:
            _counters[ranks_path] = TrieCounter(zipf_vocabulary(ranks_path))
        counter = _counters[ranks_path]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                split = [[b" " + w for w in t.split()] for t in raw_texts(batch.column(1))]
                yield as_batch(SCHEMA, doc_id=batch.column(0), n_pretokens=[len(s) for s in split], n_tokens=counter.documents(split))

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
