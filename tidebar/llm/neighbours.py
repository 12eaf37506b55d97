"""Approximate nearest neighbours by learned partitions (operator 7).

On a bounded sample the driver builds a nearest-neighbour graph, splits it into balanced parts that cut few edges,
and trains a small network to tell a vector's part. The network then files every row under its most probable part
and sends each query to its several most probable ones: as many as it takes for the neighbours of sample rows that
it was not trained on to be found at `recall`. Rows of a part are searched exactly. Parts and the queries sent to them are
cut into blocks of bounded size by a hash of the id, so that neither a hot part nor a very common vector is one
task's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Rows of a part, on average, beyond which there are more parts.
ROWS_OF_A_PART = 250_000
#: Rows, and queries, of a block at about the most.
BLOCK = 16_384
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Router:
    """Two-layer network from unit vectors to parts."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.d)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.a + self.b, 0) @ self.c + self.d


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their magnitude."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_in(x: np.ndarray, k: int, asked: np.ndarray | None = None) -> np.ndarray:
    """k nearest others in x of its rows `asked`, of all if none are named."""
    k, x = min(k, len(x) - 1), x.astype(np.float32)
    asked = np.arange(len(x)) if asked is None else asked
    out = np.empty((len(asked), k), dtype=np.int64)
    for at in range(0, len(asked), 256):
        own = asked[at : at + 256]
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        out[at : at + 256] = np.argpartition(s, len(x) - k, axis=1)[:, len(x) - k :]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int, rng: np.random.Generator, slack: float = 1.05) -> np.ndarray:
    """Parts of about equal size that keep neighbours together: halving along principal axes, then refinement.

    In each round a vertex wants the part that holds most of its neighbours; wishes are granted by gain while
    the part has room.
    """
    part = np.zeros(len(x), dtype=np.int64)
    for _ in range(int(math.log2(parts))):
        new = np.empty_like(part)
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            centred = x[at] - x[at].mean(0)
            axis = rng.normal(size=x.shape[1])
            for _ in range(6):
                axis = centred.T @ (centred @ axis)
                axis /= np.linalg.norm(axis) + 1e-30
            ranks = np.empty(len(at), dtype=np.int64)
            ranks[np.argsort(centred @ axis, kind="stable")] = np.arange(len(at))
            new[at] = 2 * p + (ranks >= len(at) // 2)
        part = new
    room = math.ceil(len(x) / parts * slack)
    rows = np.repeat(np.arange(len(x)), graph.shape[1])
    ends = np.concatenate([rows, graph.ravel()]), np.concatenate([graph.ravel(), rows])
    for _ in range(rounds):
        # ties of each vertex to each part that it has any to
        key, ties = np.unique(ends[0] * parts + part[ends[1]], return_counts=True)
        holder = key // parts
        order = np.lexsort((key, -ties, holder))
        first = order[np.searchsorted(holder[order], np.arange(len(x)))]
        want, gain = key[first] % parts, ties[first].astype(np.float64)
        own = np.searchsorted(key, np.arange(len(x)) * parts + part)
        own[own == len(key)] = 0
        gain -= np.where(key[own] == np.arange(len(x)) * parts + part, ties[own], 0)
        size = np.bincount(part, minlength=parts)
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
    return part


def train(x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 30) -> Router:
    """Cross entropy by Adam on batches of 256."""
    d = x.shape[1]
    w = [rng.normal(size=(d, hidden)) * math.sqrt(2 / d), np.zeros(hidden), rng.normal(size=(hidden, parts)) * math.sqrt(1 / hidden), np.zeros(parts)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(i)), part[i]] -= 1
            z /= len(i)
            back = (z @ w[2].T) * (h > 0)
            step += 1
            for p, g, a, b in zip(w, (x[i].T @ back, back.sum(0), h.T @ z, z.sum(0)), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Router(*w)


def learn(sample: np.ndarray, parts: int, k: int, recall: float, seed: int = 11) -> Router:
    """A router over the sample (unit vectors); parts is the power of two below, and four distinct rows a part at least.

    A fifth of the rows (4,096 at most) is left out of graph and training; their neighbours tell the number of probes.
    """
    rng = np.random.default_rng(seed)
    x = np.unique(sample, axis=0)
    parts = 2 ** int(math.log2(max(1, min(parts, max(2, len(x) // 4)))))
    if len(x) < 8 or parts == 1:
        d = sample.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    order = rng.permutation(len(x))
    asked, fitted = np.split(order, [min(4096, len(x) // 5)])
    router = train(x[fitted], balanced_parts(x[fitted], nearest_in(x[fitted], 10), parts, 12, rng), parts, rng)
    filed = np.concatenate([router.scores(x[at : at + 4096]).argmax(1) for at in range(0, len(x), 4096)])
    needed = []
    for at in range(0, len(asked), 1024):
        rows = asked[at : at + 1024]
        scores = router.scores(x[rows])
        for near in nearest_in(x, k, rows).T:
            needed.append((scores > scores[np.arange(len(rows)), filed[near]][:, None]).sum(1))
    needed = np.sort(np.concatenate(needed))
    router.probes = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _filed(router: Router, probes: int):
    """Each row with its `probes` most probable parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = router.scores(unit(_matrix(batch.column("embedding"))))
                top = np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, top.shape[1], dtype=np.int32)), pa.array(top.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), parts], ["vec_id", "embedding", "parts"])

    return run


def _search(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding").combine_chunks())
        # Of equal vectors the k + 1 least ids can be wanted, no others.
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]).any(1)))
        start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        repeat = np.unique(ids, return_counts=True)[1].max()
        good = np.arange(len(ids)) - start < (k + 1) * repeat
        ids, x = ids[good], x[good]
        norms, ux = np.linalg.norm(x, axis=1), unit(x)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        q_ids, q = asked.column("vec_id").to_numpy(), _matrix(asked.column("embedding").combine_chunks())
        most = min(len(ids), (k + 1) * repeat)
        for at in range(0, len(q), 256):
            part, part_ids = q[at : at + 256], q_ids[at : at + 256]
            s = unit(part) @ ux.T
            least = np.partition(s, len(ids) - most, axis=1)[:, len(ids) - most]
            i, j = np.nonzero(s >= least[:, None] - 1e-9)
            other = ids[j] != part_ids[i]
            i, j = i[other], j[other]
            # the measure itself, by the same sum for every pair
            score = np.einsum("ij,ij->i", part[i], x[j]) / (np.linalg.norm(part[i], axis=1) * norms[j])
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, i)
            top = np.arange(len(i)) - first < k * repeat
            out.append((part_ids[i[top]], ids[j[top]], score[top]))
        a, b, c = (np.concatenate(v) for v in zip(*out))
        return pa.table({"query_id": a, "vec_id": b, "score": c}, schema=schema)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of rows that have an id and a finite vector other than zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("embedding")).where(fine)


def search(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = 0.95, parts: int = 64, most_sample: int = 32_768) -> DataFrame:
    """k nearest found of every row whose vec_id is divisible by `every`, among all other rows.

    Returns query_id, rank (from 1), vec_id, score (cosine in double precision), nearest first, ties to the smaller
    vec_id. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
    vec_id and vectors of another length than most of the sample have. Rows with the same vec_id are one candidate,
    by its best score. The sample is the rows with the least hashes, `most_sample` at the most. There are `parts` parts, or
    as many more (a power of two) as it takes for ROWS_OF_A_PART rows each, but one for every four distinct vectors of
    the sample at the most. Other columns are ignored; an empty table gives no rows.
    """
    rows = usable(vectors)
    n = rows.count()
    parts = max(parts, 2 ** math.ceil(math.log2(max(1, n / ROWS_OF_A_PART))))
    share = min(1.0, 1.25 * most_sample / max(1, n))  # of all hashes; few rows beyond the sample pass, on any number of partitions
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = drawn.orderBy(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)), "vec_id").limit(most_sample).collect()  # bounded by most_sample
    sizes = [len(r["embedding"]) for r in sample]
    dims = max(sorted(set(sizes)), key=sizes.count) if sizes else 1
    x = np.array([r["embedding"] for r in sample if len(r["embedding"]) == dims]).reshape(-1, dims)
    router = learn(unit(x) if len(x) else x, parts, k, recall)

    rows = rows.where(F.size("embedding") == dims)
    asks = rows.where(F.col("vec_id") % every == 0)
    of = "vec_id long, embedding array<double>, parts array<int>"
    filed = keep(rows.mapInArrow(_filed(router, 1), of).select("vec_id", "embedding", F.col("parts")[0].alias("part")))
    sent = keep(asks.mapInArrow(_filed(router, router.probes), of).select("vec_id", "embedding", F.explode("parts").alias("part")))

    def blocks(df: DataFrame) -> list[int]:
        got = {r["part"]: r["n"] for r in df.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number for each part
        return [max(1, math.ceil(got.get(p, 0) / BLOCK)) for p in range(router.parts)]

    def pick(numbers: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, numbers)), F.col("part") + 1)

    row_blocks, ask_blocks = pick(blocks(filed)), pick(blocks(sent))
    own = F.xxhash64("vec_id")
    left = filed.withColumn("r", F.pmod(own, row_blocks).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), ask_blocks - 1)))
    right = sent.withColumn("q", F.pmod(own, ask_blocks).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), row_blocks - 1)))
    found = left.groupBy("part", "r", "q").cogroup(right.groupBy("part", "r", "q")).applyInArrow(_search(k), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
