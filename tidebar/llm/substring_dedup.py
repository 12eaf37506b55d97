"""Substring deduplication by fixed-block anchors (operator 6).

A window of `window` words holds at least one whole block of a document's grid of non-overlapping blocks of half
that length. So of two equal windows, each has a block of the other's grid at one of its rolling positions:

1. anchors: every document's grid blocks are indexed, every rolling window of a block's length probes them;
2. extension: around the anchors hit, windows of full length are compared, and each distinct one's first start
   is found; adjoining repeated windows together are the maximal exact repeats;
3. cutting: words under a window that starts earlier elsewhere go.

Documents travel in batches of rows, named by file and row number, so that a lost task makes the same batches
again. A batch sends each distinct hash once, as packed arrays by hash bucket; a passage in a third of all documents is
thus sent once a batch, and the answer goes back to batches. Anchors use short hashes, as a false one costs only
time; windows are compared by 128 bits, two hashes of their words that are made from different word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordHashes, grams, in_batches, keep, partitions, raw_texts

LAST = np.iinfo(np.int64).max

PROBE = "bid long, bucket int, blob binary"
HIT = "bid long, blob binary"
PACKED = "bid long, docs binary"
OUT = "kind int, bid long, bucket int, blob binary, doc_id long, n_words long, n_removed long, kept_sha256 string"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def by_batch(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with the same bid."""
    bid = batch.column("bid").to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero(bid[1:] != bid[:-1]) + 1, [len(bid)])) if len(bid) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bid[a]), batch.slice(a, b - a)


def split_by_top_bits(ordered: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) for the runs of sorted hashes with the same leading bits."""
    if not len(ordered):
        return []
    bucket = (ordered >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 30 bits behind the leading ones, two bits up: room for two flags."""
    return ((hashes << np.uint64(bits)) >> np.uint64(34)).astype(np.uint32) << np.uint32(2)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [pa.field(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def _probes(block: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for bid, part in by_batch(whole):
                rolling, grid = [], []
                for text in raw_texts(part.column("text")):
                    g = grams(hashes.of(text.split()), block)
                    rolling.append(g)
                    grid.append(np.arange(len(g)) % block == 0)
                h, on_grid = np.concatenate(rolling), np.concatenate(grid)
                order = np.argsort(h)
                h, on_grid = h[order], on_grid[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
                if not len(first):
                    continue
                many = np.diff(np.append(first, len(h))) > 1
                indexed = np.add.reduceat(on_grid.astype(np.int64), first) > 0
                code = short(h[first], bits) | indexed.astype(np.uint32) << np.uint32(1) | many.astype(np.uint32)
                rows = [(bid, k, code[a:b].tobytes()) for k, a, b in split_by_top_bits(h[first], bits)]
                yield _rows(PROBE, rows)

    return run


def _answer_probes(key: tuple, table: pa.Table) -> pa.Table:
    """To each batch the short hashes of its own that are a grid block somewhere and occur twice or more."""
    blobs = [np.frombuffer(b, dtype=np.uint32) for b in table.column("blob").to_pylist()]
    code = np.concatenate(blobs)
    value = code >> np.uint32(2)
    values, inverse, times = np.unique(value, return_inverse=True, return_counts=True)
    indexed, many = np.zeros(len(values), bool), times > 1
    indexed[inverse[(code & 2) > 0]] = True
    many[inverse[(code & 1) > 0]] = True
    good = (indexed & many)[inverse]
    bucket = np.uint64(key[0].as_py())
    rows, at = [], 0
    for bid, b in zip(table.column("bid").to_pylist(), blobs):
        hit = value[at : at + len(b)][good[at : at + len(b)]]
        at += len(b)
        if len(hit):
            rows.append((bid, (hit.astype(np.uint64) | bucket << np.uint64(32)).tobytes()))
    return pa.Table.from_batches([_rows(HIT, rows)])


class Lanes:
    """Windows of a text as two 64-bit hashes each, (n, 2)."""

    def __init__(self, window: int):
        self.window, self.low, self.high = window, WordHashes(), WordHashes(seed=1)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.stack([grams(self.low.of(words), self.window), grams(self.high.of(words), self.window)], axis=1)


def _firsts(w: np.ndarray) -> np.ndarray:
    """Whether each row of w is the first of its kind."""
    order = np.lexsort((np.arange(len(w)), w[:, 1], w[:, 0]))
    out = np.zeros(len(w), dtype=bool)
    if len(w):
        ordered = w[order]
        out[order[np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(1)))]] = True
    return out


def _among(w: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each row of w is a row of known."""
    both = np.concatenate([known, w])
    order = np.lexsort((np.arange(len(both)), both[:, 1], both[:, 0]))
    ordered = both[order]
    start = np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(1))) if len(both) else np.empty(0, bool)
    head = order[np.flatnonzero(start)][np.cumsum(start) - 1]  # of each row's kind the first: one of known, if there
    out = np.zeros(len(both), dtype=bool)
    out[order] = head < len(known)
    return out[len(known) :]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def pack_rows(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_rows(blobs: list[bytes]) -> list[tuple[int | None, int, bytes]]:
    """(doc_id, order, text) of a batch's documents, ordered by doc_id (null last), then row; order is that of the ids."""
    out = []
    for blob in blobs:
        t = pa.ipc.open_stream(blob).read_all()
        out += zip(t.column("doc_id").to_pylist(), t.column("row").to_pylist(), t.column("text").to_pylist())
    out.sort(key=lambda x: (LAST if x[0] is None else x[0], x[1]))
    return [(doc, LAST if doc is None else doc, text or b"") for doc, _, text in out]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's documents as one compressed row."""
    for whole in batches:
        for bid, part in by_batch(whole):
            rows = pa.table({"doc_id": part.column("doc_id"), "row": part.column("row"), "text": part.column("text").cast(pa.binary())})
            yield _rows(PACKED, [(bid, pack_rows(rows))])


def _windows(window: int, block: int, bits: int):
    """Documents without repeats are done; of the others the batch stays, and its distinct windows go out.

    A window that is repeated has all grid blocks in it among the anchors hit, and any block of the other's grid.
    """

    def run(packed: pa.Table, hits: pa.Table) -> pa.Table:
        lanes = Lanes(window)
        anchors = np.unique(np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in hits.column("blob").to_pylist()] or [np.empty(0, np.uint64)]))
        rows: list[tuple] = []
        left: list[tuple] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        bid = packed.column("bid")[0].as_py() if packed.num_rows else None
        for doc, key, text in unpack_rows(packed.column("docs").to_pylist()):
            words = text.split()
            n = max(0, len(words) - window + 1)
            at = np.empty(0, np.int64)
            if n and len(anchors):
                g = grams(lanes.low.of(words), block)
                code = (g >> np.uint64(64 - bits)) << np.uint64(32) | (g << np.uint64(bits)) >> np.uint64(34)
                place = np.searchsorted(anchors, code)
                place[place == len(anchors)] = 0
                hit = anchors[place] == code
                own = -(-np.arange(n) // block) * block  # the first grid block in each window, and the last
                at = np.flatnonzero(hit[own] & hit[(np.arange(n) + window - block) // block * block])
            if len(at):
                found.append((lanes(words)[at], np.full(len(at), key)))
                left.append((doc, len(left), text))
            else:
                rows.append((0, None, None, None, doc, len(words), 0, _sha(words)))
        if found:
            h, doc = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((doc, h[:, 1], h[:, 0]))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]).any(1))))
            h, doc = h[first], doc[first]
            rows += [(2, bid, k, h[a:b].tobytes() + doc[a:b].tobytes(), None, None, None, None) for k, a, b in split_by_top_bits(h[:, 0], bits)]
            rows.append((1, bid, None, pack_rows(pa.table(dict(zip(("doc_id", "row", "text"), map(pa.array, zip(*left)))))), None, None, None, None))
        return pa.Table.from_batches([_rows(OUT, rows)])

    return run


def _answer_windows(key: tuple, table: pa.Table) -> pa.Table:
    """To each batch those of its windows that start earlier in another one. Equal doc_ids go by batch."""
    blobs, bids = table.column("blob").to_pylist(), np.array(table.column("bid").to_pylist(), dtype=np.int64)
    sizes = [len(b) // 24 for b in blobs]
    h = np.concatenate([np.frombuffer(b, dtype=np.uint64, count=2 * n).reshape(-1, 2) for b, n in zip(blobs, sizes)])
    doc = np.concatenate([np.frombuffer(b, dtype=np.int64, offset=16 * n) for b, n in zip(blobs, sizes)])
    batch = np.repeat(np.arange(len(blobs)), sizes)
    order = np.lexsort((bids[batch], doc, h[:, 1], h[:, 0]))
    h, batch = h[order], batch[order]
    late = np.concatenate(([False], (h[1:] == h[:-1]).all(1)))
    h, batch = h[late], batch[late]
    order = np.argsort(batch, kind="stable")
    h, batch = h[order], batch[order]
    cuts = np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1], [True]))) if len(h) else []
    return pa.Table.from_batches([_rows(HIT, [(int(bids[batch[a]]), h[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])])])


def _cut(window: int):
    """Words under a window that starts earlier: in another batch, as told, or before in this one."""

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        lanes = Lanes(window)
        late = np.concatenate([np.frombuffer(b, dtype=np.uint64).reshape(-1, 2) for b in answers.column("blob").to_pylist()] or [np.empty((0, 2), np.uint64)])
        docs = [(doc, text.split()) for doc, _, text in unpack_rows(packed.column("blob").to_pylist())]
        per = [lanes(words) for _, words in docs]
        w = np.concatenate(per) if per else np.empty((0, 2), np.uint64)
        repeated = ~_firsts(w)
        if len(late):
            repeated |= _among(w, late)
        rows, at = [], 0
        for (doc, words), mine in zip(docs, per):
            starts = np.flatnonzero(repeated[at : at + len(mine)])
            at += len(mine)
            kept = words
            if len(starts):
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                kept = [x for x, k in zip(words, (np.cumsum(edge)[:-1] == 0).tolist()) if k]
            rows.append((doc, len(words), len(words) - len(kept), _sha(kept)))
        return pa.Table.from_batches([_rows(RESULT, rows)])

    return run


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Remove each word under a `window`-word window whose words also start earlier.

    Words are `[^\\x20\\x09-\\x0D]+`. Earlier is a smaller doc_id, or the same document and an earlier start; rows with
    the same doc_id go by batch and row number, a null doc_id comes last. Returns doc_id, n_words, n_removed and kept_sha256
    of the kept words joined by a space. A null text has no words; texts shorter than a window lose nothing; other
    columns are ignored; an empty table gives no rows.
    """
    if window % 2:
        raise ValueError("window must be even")
    block = window // 2
    bits = max(6, (8 * partitions(docs.sparkSession) - 1).bit_length())
    docs = in_batches(docs)
    probes = docs.select("text", "bid").mapInArrow(_probes(block, bits), PROBE)
    hits = keep(probes.groupBy("bucket").applyInArrow(_answer_probes, HIT))
    packed = docs.mapInArrow(_packed, PACKED)
    split = keep(packed.groupBy("bid").cogroup(hits.groupBy("bid")).applyInArrow(_windows(window, block, bits), OUT))
    answers = split.where("kind = 2").select("bid", "bucket", "blob").groupBy("bucket").applyInArrow(_answer_windows, HIT)
    left = split.where("kind = 1").select("bid", "blob")
    cut = left.groupBy("bid").cogroup(answers.groupBy("bid")).applyInArrow(_cut(window), RESULT)
    done = split.where("kind = 0").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(cut)
