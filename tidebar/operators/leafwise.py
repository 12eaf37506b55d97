"""Boosted trees grown leaf by leaf, for the stage-2 question whether stage 1 is right.

Features are cut into bins once and stored as blocks of rows. A job counts, in every task, gradients by (leaf, feature, bin)
and a tree of tasks adds the counts up; the driver picks splits from them. The best leaf is split first, as long as the
tree may grow; since a leaf's best split hangs on its own rows alone, one job makes the counts of all leaves that would be
split next if their children had nothing to gain, and jobs follow until no guess is left in the order. Of two children only
the smaller is counted, the other is what remains of the parent.

Scores of rows are those of the trees so far: they are stored with the blocks every REFRESH trees, and the trees since then
are applied on the way. Nothing but counts of a fixed size and the trees reaches the driver.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import forget, keep, tree_sum, workers_find_us

#: Trees that are applied on the way before scores are stored anew.
REFRESH = 16


@dataclass(frozen=True)
class Growth:
    """How trees grow; the defaults are those of production."""

    trees: int = 800
    rate: float = 0.02
    leaves: int = 63
    least_rows: int = 40
    least_weight: float = 1e-3
    feature_share: float = 0.7
    row_share: float = 0.8
    row_share_every: int = 5
    alpha: float = 0.1
    shrink: float = 0.1
    patience: int = 50
    bins: int = 255
    seed: int = 42


@dataclass
class Tree:
    """Nodes as lists: feature (-1: a leaf), bin (up to it: left), left, right, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, bin, at, at + 1
        for part, x in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            part += [x, x]
        return at, at + 1

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        """The leaf that each row of codes (rows, features) comes to."""
        feature, cut, left, right = map(np.array, (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
        while (inner := feature[node] >= 0).any():
            go = codes[rows, np.maximum(feature[node], 0)] <= cut[node]
            node = np.where(inner, np.where(go, left[node], right[node]), node)
        return node


@dataclass
class Boosted:
    """Trees over named features; edges: of each feature, the upper ends of its bins but the last."""

    names: list[str]
    edges: list[list[float]]
    trees: list[Tree]
    base: float
    losses: list[float] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return coded(x, self.edges)

    def scores(self, x: np.ndarray) -> np.ndarray:
        codes, out = self.codes(x), np.full(len(x), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.leaf_of(codes)]
        return out

    def predict(self, df: DataFrame, name: str = "meta_prob") -> DataFrame:
        """df with the probability of class 1."""
        workers_find_us(df.sparkSession)
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def prob(x: pd.DataFrame) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-sent.value.scores(x.to_numpy(np.float64)))))

        return df.withColumn(name, prob(F.struct(*[F.col(n).cast("double").alias(n) for n in self.names])))

    def importance(self, n: int = 20) -> list[tuple[str, int]]:
        """The features that most splits use."""
        used = [0] * len(self.names)
        for t in self.trees:
            for f in t.feature:
                if f >= 0:
                    used[f] += 1
        return sorted(zip(self.names, used), key=lambda x: (-x[1], x[0]))[:n]

    def save(self, spark: SparkSession, path: str) -> None:
        head = {"names": self.names, "edges": self.edges, "base": self.base, "losses": self.losses}
        rows = [(-1, json.dumps(head)), *((i, json.dumps(asdict(t))) for i, t in enumerate(self.trees))]
        spark.createDataFrame(rows, "number int, value string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        head, *trees = (json.loads(r["value"]) for r in spark.read.parquet(path).orderBy("number").collect())  # a row for each tree
        return Boosted(trees=[Tree(**t) for t in trees], **head)


def coded(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bins of values (rows, features); what is missing is in the last."""
    x = np.where(np.isnan(x), np.inf, x)
    return np.column_stack([np.searchsorted(np.array(e), x[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def bin_edges(df: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """Distinct quantiles of each feature over all rows, to within a ten-thousandth of them; one aggregate."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(n).cast("double"), shares, F.lit(10_000)).alias(f"q{i}") for i, n in enumerate(names)]).first()
    return [sorted({float(v) for v in row[f"q{i}"] or []}) for i in range(len(names))]


def _blocks(df: DataFrame, names: list[str], edges: list[list[float]]) -> DataFrame:
    """Stored blocks: block, rows, codes, y, w (weight), held (true: validation), score, as bytes."""
    sent = df.sparkSession.sparkContext.broadcast(edges)
    kinds = pa.schema([("block", pa.int64()), ("rows", pa.int64()), *((c, pa.binary()) for c in ("codes", "y", "w", "held", "score"))])

    def pack(batches):
        for i, b in enumerate(batches):
            if b.num_rows:
                x = np.column_stack([b.column(f"f{j}").to_numpy(zero_copy_only=False) for j in range(len(names))])
                y, w, held, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "held", "part"))
                values = [(int(part[0]) << 24) + i, b.num_rows, coded(x, sent.value).tobytes(), y.astype(np.float64).tobytes(), w.astype(np.float64).tobytes(), held.astype(np.uint8).tobytes(), np.zeros(b.num_rows).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds)], schema=kinds)

    plain = df.select(*[F.col(n).cast("double").alias(f"f{j}") for j, n in enumerate(names)], "y", "w", "held", F.spark_partition_id().alias("part"))
    return keep(plain.mapInArrow(pack, "block long, rows long, codes binary, y binary, w binary, held binary, score binary"))


def _drawn(block: int, rows: int, salt: int, share: float) -> np.ndarray:
    """Which rows of a block a tree sees: the same ones for all its jobs."""
    z = (np.arange(rows, dtype=np.uint64) + np.uint64(block << 20)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


class _Counter:
    """Counts of one tree's leaves from the stored blocks."""

    def __init__(self, blocks: DataFrame, features: int, bins: int, base: float, recent: list[Tree], salt: int, share: float):
        self.blocks, self.features, self.bins, self.share, self.salt = blocks, features, bins, share, salt
        self.base, self.recent = base, recent

    def count(self, tree: Tree, leaves: list[int], check: bool = False) -> tuple[np.ndarray, tuple[float, float]]:
        """(leaf, feature, bin, 3): sums of gradient, second derivative and rows of the training rows drawn; the loss of the
        validation rows before this tree, and how many they are."""
        features, bins, base, share, salt = self.features, self.bins, self.base, self.share, self.salt
        sent = self.blocks.sparkSession.sparkContext.broadcast((tree, self.recent))
        slot = {leaf: i for i, leaf in enumerate(leaves)}
        size = len(leaves) * features * bins * 3

        def run(batches):
            tree, recent = sent.value
            acc, loss = np.zeros((3, len(leaves) * features * bins)), np.zeros(2)
            slots = np.full(len(tree.feature), -1)
            for leaf, i in slot.items():
                slots[leaf] = i
            for b in batches:
                for block, n, codes, y, w, held, score in zip(*(b.column(c).to_pylist() for c in ("block", "rows", "codes", "y", "w", "held", "score"))):
                    codes = np.frombuffer(codes, np.uint8).reshape(n, features)
                    y, w, held, score = np.frombuffer(y), np.frombuffer(w), np.frombuffer(held, np.uint8) > 0, np.frombuffer(score) + base
                    for t in recent:
                        score = score + np.array(t.value)[t.leaf_of(codes)]
                    if check and held.any():
                        loss += np.logaddexp(0, np.where(y[held] > 0, -score[held], score[held])).sum(), held.sum()
                    at = slots[tree.leaf_of(codes)]
                    use = (at >= 0) & ~held & _drawn(block, n, salt, share)
                    p = 1 / (1 + np.exp(-score[use]))
                    g, h = w[use] * (p - y[use]), w[use] * p * (1 - p)
                    cell = ((at[use, None] * features + np.arange(features)) * bins + codes[use]).ravel()
                    for i, v in enumerate((g, h, np.ones(len(g)))):
                        acc[i] += np.bincount(cell, np.repeat(v, features), acc.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([acc.T.ravel(), loss]).tobytes()], pa.binary())], ["blob"])

        got = tree_sum(self.blocks.mapInArrow(run, "blob binary"), size + 2)
        sent.destroy()
        return got[:size].reshape(len(leaves), features, bins, 3), (got[-2], got[-1])


def best_split(counts: np.ndarray, used: np.ndarray, how: Growth) -> tuple[float, int, int]:
    """gain, feature, bin of the best split of a leaf with these counts (feature, bin, 3); gain 0 if there is none."""

    def worth(g, h):
        return np.maximum(np.abs(g) - how.alpha, 0) ** 2 / (h + how.shrink)

    left = counts.cumsum(1)[:, :-1]
    whole = counts[0].sum(0)
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = worth(left[..., 0], left[..., 1]) + worth(right[..., 0], right[..., 1]) - worth(whole[0], whole[1])
    fine = (np.minimum(left[..., 2], right[..., 2]) >= how.least_rows - 0.5) & (np.minimum(left[..., 1], right[..., 1]) >= how.least_weight) & used[:, None]
    gain = np.where(fine & (gain > 1e-12), np.round(gain, 9), 0.0)
    if not gain.size or not gain.max():
        return 0.0, -1, 0
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def leaf_value(counts: np.ndarray, how: Growth) -> float:
    g, h = counts[0].sum(0)[:2]
    return float(-np.sign(g) * max(abs(g) - how.alpha, 0) / (h + how.shrink) * how.rate) if h > 0 else 0.0


def _grown(counter: _Counter, root: np.ndarray, used: np.ndarray, how: Growth) -> Tree:
    """The tree that splits its best leaf first, until it has `leaves` leaves or nothing to gain."""
    tried, counts, best = Tree(), {0: root}, {0: best_split(root, used, how)}
    while True:
        line, leaves, wanted = [(-best[0][0], 0)], 1, []
        order: list[int] = []
        while line and leaves < how.leaves:
            gain, node = heapq.heappop(line)
            if not gain:
                break
            leaves += 1
            order.append(node)
            if tried.feature[node] < 0:
                wanted.append(node)
            else:
                for child in (tried.left[node], tried.right[node]):
                    heapq.heappush(line, (-best[child][0], child))
        if not wanted:
            break
        smaller = {}
        for node in wanted:
            _, f, b = best[node]
            rows = counts[node][f, :, 2].cumsum()
            left, right = tried.split(node, f, b)
            smaller[node] = (left, right) if rows[b] * 2 <= rows[-1] else (right, left)
        made, _ = counter.count(tried, [few for few, _ in smaller.values()])
        for (node, (few, many)), c in zip(smaller.items(), made):
            counts[few], counts[many] = c, counts[node] - c
            for child in (few, many):
                best[child] = best_split(counts[child], used, how)
    out, at = Tree(), {0: 0}
    for node in order:
        at[tried.left[node]], at[tried.right[node]] = out.split(at[node], tried.feature[node], tried.bin[node])
    for node, to in at.items():
        out.value[to] = leaf_value(counts[node], how)
    return out


def _with_scores(blocks: DataFrame, trees: list[Tree]) -> DataFrame:
    """The stored blocks with the trees' values added to the scores."""
    sent = blocks.sparkSession.sparkContext.broadcast(trees)
    at = blocks.columns.index("score")

    def run(batches):
        for b in batches:
            out = []
            for n, codes, score in zip(*(b.column(c).to_pylist() for c in ("rows", "codes", "score"))):
                codes = np.frombuffer(codes, np.uint8).reshape(n, -1)
                score = np.frombuffer(score).copy()
                for t in sent.value:
                    score += np.array(t.value)[t.leaf_of(codes)]
                out.append(score.tobytes())
            yield b.set_column(at, "score", pa.array(out, pa.binary()))

    return keep(blocks.mapInArrow(run, blocks.schema))


def fit(df: DataFrame, names: list[str], y: str = "y_meta", held: str = "held", how: Growth = Growth(), edges: list[list[float]] | None = None) -> Boosted:
    """Trees for class 1 of column y from the rows where `held` is false, classes weighted to balance.

    After each tree the loss of the held rows is taken, and growth ends when `patience` trees brought nothing better; the
    trees up to the best are kept. Without held rows, or training rows of both classes, there is no such end, or no tree.
    """
    spark = df.sparkSession
    workers_find_us(spark)
    train = ~F.col(held)
    n, ones = df.where(train).agg(F.count("*"), F.sum(F.col(y).cast("long"))).first()
    edges = bin_edges(df.where(train), names, how.bins) if edges is None else edges
    model = Boosted(list(names), edges, [], 0.0)
    if not n or not ones or ones == n or not names:
        model.base = 0.0 if not n or not names else (10.0 if ones else -10.0)
        return model
    weight = F.when(F.col(y) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
    rows = df.select(*names, F.col(y).cast("double").alias("y"), weight.alias("w"), F.col(held).alias("held"))
    blocks = _blocks(rows, names, edges)
    bins = max(map(len, edges)) + 1
    rng = np.random.default_rng(how.seed)
    recent, best = [], (np.inf, 0)
    while True:
        k = len(model.trees)
        used = np.zeros(len(names), bool)
        used[rng.choice(len(names), max(1, round(how.feature_share * len(names))), replace=False)] = True
        counter = _Counter(blocks, len(names), bins, model.base, recent, how.seed + k // how.row_share_every, how.row_share)
        root, (loss, of) = counter.count(Tree(), [0], check=True)
        if of:
            model.losses.append(loss / of)
            if loss / of < best[0]:
                best = loss / of, k
        if k == how.trees or of and k - best[1] >= how.patience:
            break
        tree = _grown(counter, root[0], used, how)
        if tree.feature == [-1] and not tree.value[0]:
            break
        model.trees.append(tree)
        recent = [*recent, tree]
        if len(recent) == REFRESH:
            old, blocks, recent = blocks, _with_scores(blocks, recent), []
            forget(old)
    forget(blocks)
    if model.losses:
        model.trees = model.trees[: best[1]]
    return model
