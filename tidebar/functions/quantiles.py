"""Exact quantiles of many columns at once by refinement of histograms.

A double is read as a 64-bit number of the same order. Each pass over the table counts, for every column and every rank
that is looked for, the values that share what is known of its leading bits by their next BITS bits; the counts say which
bits come next. A task holds counts of a fixed size, not values, whatever the number of rows, and passes end as soon as
every rank's value is settled: at most ceil(64 / BITS), about three on measured data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import tree_sum, workers_find_us

BITS = 12
#: Values of a rank's bits that are fetched instead of counted once more.
FEW = 256
SIGN = np.uint64(1 << 63)
#: Of one batch of rows: (group, matrix of rows and columns), again and again.
Read = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


def keys_of(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of doubles: minus zero is zero, NaN is above all."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = np.ascontiguousarray(x, dtype=np.float64).view(np.uint64)
    return np.where(bits & SIGN != 0, ~bits, bits | SIGN)


def values_of(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, dtype=np.uint64)
    return np.where(keys & SIGN != 0, keys ^ SIGN, ~keys).view(np.float64)


def matrices(names: list[str]) -> Read:
    """Rows of a plain table as one group; nulls are left out as masked keys."""

    def read(batch: pa.RecordBatch):
        yield 0, np.column_stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]) if batch.num_rows else np.zeros((0, len(names)))

    return read


def _found(keys: np.ndarray, prefixes: np.ndarray, known: int) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """Of each column and prefix its ranks, and the remaining bits of the keys that begin with it."""
    head = keys >> np.uint64(64 - known) if known else np.zeros_like(keys)
    rest = keys & np.uint64((1 << (64 - known)) - 1)
    for c in range(keys.shape[1]):
        ranks: dict[int, list[int]] = {}
        for r, p in enumerate(prefixes[c].tolist()):
            ranks.setdefault(p, []).append(r)
        for p, of in ranks.items():
            yield c, of, rest[head[:, c] == np.uint64(p), c]


def _pass(rows: DataFrame, read: Read, prefixes: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts (group, column, rank, next bits) of the keys whose first `known` bits are a rank's; least and largest rest."""
    bits = min(BITS, 64 - known)
    shape, n = (*prefixes.shape, 1 << bits), prefixes.size

    def count(batches):
        acc, low, high = np.zeros(shape), np.full(prefixes.shape, -np.inf), np.full(prefixes.shape, -np.inf)
        for batch in batches:
            for g, x in read(batch):
                for c, of, rest in _found(keys_of(x), prefixes[g], known):
                    if len(rest):
                        acc[g, c, of] += np.bincount((rest >> np.uint64(64 - known - bits)).astype(np.int64), minlength=1 << bits)
                        low[g, c, of], high[g, c, of] = np.maximum(low[g, c, of], -float(rest.min())), np.maximum(high[g, c, of], float(rest.max()))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([acc.ravel(), low.ravel(), high.ravel()]).tobytes()], type=pa.binary())], ["blob"])

    got = tree_sum(rows.mapInArrow(count, "blob binary"), math.prod(shape), 2 * n)
    return got[: math.prod(shape)].reshape(shape), -got[-2 * n : -n].reshape(prefixes.shape), got[-n:].reshape(prefixes.shape)


def _collected(rows: DataFrame, read: Read, prefixes: np.ndarray, known: int, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """By slot (index into prefixes) the sorted rests of its keys. Every wanted slot has FEW of them at the most."""

    def run(batches):
        for batch in batches:
            for g, x in read(batch):
                for c, of, rest in _found(keys_of(x), prefixes[g], known):
                    if len(rest) and any(wanted[g, c, r] for r in of):
                        slot = np.ravel_multi_index((g, c, of[0]), prefixes.shape)
                        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([rest.tobytes()], pa.binary())], ["slot", "rest"])

    got: dict[int, list[np.ndarray]] = {}
    for r in rows.mapInArrow(run, "slot long, rest binary").collect():  # at most FEW numbers a slot
        got.setdefault(r["slot"], []).append(np.frombuffer(r["rest"], dtype=np.uint64))
    return {s: np.sort(np.concatenate(x)) for s, x in got.items()}


def quantiles(rows: DataFrame, read: Read, groups: int, columns: int, probs: tuple[float, ...]) -> np.ndarray:
    """(group, column, prob): exact quantiles, interpolated between neighbouring ranks; NaN for a group without rows.

    rows is read once for each pass and should be a stored table. Missing values are NaN in the matrices, and count as
    greater than all others.
    """
    workers_find_us(rows.sparkSession)
    counts, _, _ = _pass(rows, read, np.zeros((groups, columns, 1), dtype=np.uint64), 0)
    total = counts[:, :, 0].sum(-1)
    place = np.maximum(total - 1, 0)[..., None] * np.asarray(probs)
    left = np.concatenate([np.floor(place), np.ceil(place)], -1)
    counts = np.repeat(counts, left.shape[-1], axis=2)
    prefixes, known = np.zeros(left.shape, dtype=np.uint64), 0
    keys, settled = np.zeros(left.shape, dtype=np.uint64), np.repeat((total == 0)[..., None], left.shape[-1], -1)
    while True:
        bits = min(BITS, 64 - known)
        upto = counts.cumsum(-1)
        at = np.minimum((upto <= left[..., None]).sum(-1), (1 << bits) - 1)
        left = left - np.where(at > 0, np.take_along_axis(upto, np.maximum(at - 1, 0)[..., None], -1)[..., 0], 0)
        held = np.take_along_axis(counts, at[..., None], -1)[..., 0]
        prefixes = (prefixes << np.uint64(bits)) | at.astype(np.uint64)
        known += bits
        if known == 64:
            keys = np.where(settled, keys, prefixes)
            break
        if (settled | (held <= FEW)).all():
            of = _collected(rows, read, prefixes, known, ~settled) if not settled.all() else {}
            for g, c, r in np.argwhere(~settled):
                first = int(np.argmax(prefixes[g, c] == prefixes[g, c, r]))
                rest = of[int(np.ravel_multi_index((g, c, first), prefixes.shape))]
                keys[g, c, r] = (prefixes[g, c, r] << np.uint64(64 - known)) | rest[int(left[g, c, r])]
            break
        counts, least, most = _pass(rows, read, prefixes, known)
        same = (least == most) & ~settled
        keys = np.where(same, (prefixes << np.uint64(64 - known)) | np.where(same, most, 0).astype(np.uint64), keys)
        settled = settled | same
    found = np.where(total[..., None] > 0, values_of(keys), np.nan)
    low, high = found[..., : len(probs)], found[..., len(probs) :]
    with np.errstate(invalid="ignore"):
        return np.where(low == high, low, low + (high - low) * (place - np.floor(place)))
