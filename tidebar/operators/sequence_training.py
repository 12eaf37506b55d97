"""Training of the window network over Spark: windows, gradients and models spread over tasks.

A series is stored as blocks of rows, each behind the length - 1 rows before it, so windows are cut inside a task and never
written out. One job is one step: every task adds up the gradients of the windows of its blocks, for all models at once,
and a tree of tasks adds those up. Models that differ in what they train on (the model itself, and one for each fold or
walk-forward window) are a key in the summed vector, not a loop of jobs: a step of all of them reads the table once.

The state behind each epoch is a table; a run that is started again on its folder goes on from the last whole one.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import KEY
from ..functions.quantiles import quantiles
from ..functions.store import delete, finished, keep, shared_dir, tree_sum, workers_find_us
from .attention import CLASSES, Shape, loss_and_gradient, probabilities
from .evaluate import PROBS, argmax

BLOCK_ROWS = 1024
#: Windows that go through the network at once.
CHUNK = 128
#: (first row, end) of the training rows and of those it is validated on, of each model, by the number of rows of a series.
Parts = Callable[[int], list[tuple[tuple[int, int], tuple[int, int]]]]


@dataclass(frozen=True)
class Training:
    """How to train; the defaults are those of production."""

    epochs: int = 60
    patience: int = 10
    rate: float = 1e-3
    least_rate: float = 5e-5
    decay: float = 1e-4
    period: int = 30
    clip: float = 1.0
    steps: int = 1
    seed: int = 42


def with_folds(train: float = 0.70, val: float = 0.15, folds: int = 5) -> Parts:
    """Model 0 trains on the first part and is validated on the second; models 1 ... folds are those of expanding folds of the
    first part."""

    def parts(n: int):
        a, b = math.floor(n * train), math.floor(n * val)
        size = a // (folds + 1)
        starts = [a - (folds + 1 - k) * size for k in range(1, folds + 1)]
        return [((0, a), (a, a + b)), *(((0, s), (s, s + size)) for s in starts)]

    return parts


def blocks(df: DataFrame, names: list[str], cls: str = "y", length: int = 60, rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored blocks of a table numbered from 0 without gaps: series, block, n (rows of the series), start (rows that belong
    to the block before), first (number of the first row), x and y as bytes. Values that are missing become 0 when scaled."""
    workers_find_us(df.sparkSession)
    if length > rows:
        raise ValueError("a block must be at least as long as a window")
    at = F.floor(F.col("seq") / rows)
    df = df.select(KEY, "seq", F.col(cls).cast("int").alias("_y"), *[F.col(n).cast("double").alias(n) for n in names])
    df = df.withColumn("block", F.explode(F.sequence(at, F.floor((F.col("seq") + length - 1) / rows))))
    counts = df.groupBy(KEY).agg((F.max("seq") + 1).alias("n"))
    df = df.join(F.broadcast(counts), KEY).where(F.col("block") * rows < F.col("n"))

    def pack(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("seq")
        first, block = int(some["seq"].iloc[0]), int(some["block"].iloc[0])
        x = some[names].to_numpy(np.float64)
        return pd.DataFrame({KEY: some[KEY].iloc[:1], "block": [block], "n": [int(some["n"].iloc[0])], "start": [block * rows - first], "first": [first], "x": [x.tobytes()], "y": [some["_y"].to_numpy(np.int8).tobytes()]})

    kind = df.schema[KEY].dataType.simpleString()
    return keep(df.groupBy(KEY, "block").applyInPandas(pack, f"{KEY} {kind}, block long, n long, start long, first long, x binary, y binary"))


def _read(batch: pa.RecordBatch, features: int):
    """series, block, n, start, first, x (rows, features), y of each block of a batch."""
    for row in zip(*(batch.column(c).to_pylist() for c in (KEY, "block", "n", "start", "first", "x", "y"))):
        yield (*row[:5], np.frombuffer(row[5], np.float64).reshape(-1, features), np.frombuffer(row[6], np.int8).astype(np.int64))


def fit_scalers(stored: DataFrame, features: int, parts: Parts, models: int) -> np.ndarray:
    """(model, 2, feature): exact median and interquartile range (0 counts as 1) over the training rows of each model."""

    def read(batch):
        for _, _, n, start, first, x, _ in _read(batch, features):
            for g, ((low, high), _) in enumerate(parts(n)):
                own = x[max(start, low - first) : max(0, high - first)]
                if len(own):
                    yield g, own

    q = quantiles(stored, read, models, features, (0.25, 0.5, 0.75))
    spread = q[..., 2] - q[..., 0]
    return np.stack([np.nan_to_num(q[..., 1]), np.where((spread == 0) | np.isnan(spread), 1.0, spread)], 1)


def _scaled(x: np.ndarray, scaler: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        z = (x - scaler[0]) / scaler[1]
    return np.where(np.isfinite(z), z, 0.0)


def _mixed(numbers: np.ndarray, salt: int) -> np.ndarray:
    """A hash of row numbers, that deals windows to the steps of an epoch."""
    z = (numbers.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _ends(n: int, start: int, first: int, rows: int, length: int, part: tuple[int, int]) -> np.ndarray:
    """Rows of a block that end a window of a part: its own rows with length - 1 rows of the part before them."""
    low, high = max(start, part[0] + length - 1 - first), min(rows, part[1] - first)
    return np.arange(low, max(low, high))


@dataclass
class Fitted:
    """Networks behind one table: model 0 and, if folds were asked for, one for each fold."""

    shape: Shape
    names: list[str]
    vectors: np.ndarray
    scalers: np.ndarray
    history: list[dict] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, self.vectors[k].tobytes(), self.scalers[k].tobytes(), json.dumps({"shape": asdict(self.shape), "names": self.names}), json.dumps([h for h in self.history if h["model"] == k])) for k in range(len(self.vectors))]
        spark.createDataFrame(rows, "model int, vector binary, scaler binary, info string, history string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        rows = spark.read.parquet(path).orderBy("model").collect()  # a row for each model
        info = json.loads(rows[0]["info"])
        vectors, scalers = (np.stack([np.frombuffer(r[c]) for r in rows]) for c in ("vector", "scaler"))
        return Fitted(Shape(**info["shape"]), info["names"], vectors, scalers.reshape(len(rows), 2, -1), [h for r in rows for h in json.loads(r["history"])])

    def history_table(self, spark: SparkSession) -> DataFrame:
        """model, epoch, train_loss, train_accuracy, val_loss, val_accuracy, rate, best."""
        columns = ["model", "epoch", "train_loss", "train_accuracy", "val_loss", "val_accuracy", "rate", "best"]
        return spark.createDataFrame([tuple(h[c] for c in columns) for h in self.history], "model int, epoch int, train_loss double, train_accuracy double, val_loss double, val_accuracy double, rate double, best boolean")

    def predict(self, stored: DataFrame, parts: Parts | None = None, models: list[int] | None = None) -> DataFrame:
        """series_id, seq, model, p_short, p_flat, p_long, pred of every row that ends a window.

        parts: of each model only rows of what it was validated on, whole windows within it; models: the ones asked for.
        """
        workers_find_us(stored.sparkSession)
        shape, scalers, chosen = self.shape, self.scalers, list(range(len(self.vectors))) if models is None else models
        vectors = stored.sparkSession.sparkContext.broadcast(self.vectors)
        kind = pa.string() if dict(stored.dtypes)[KEY] == "string" else None

        def run(batches):
            for batch in batches:
                for series, _, n, start, first, x, _ in _read(batch, shape.features):
                    for k in chosen:
                        ends = _ends(n, start, first, len(x), shape.length, parts(n)[k][1] if parts else (0, n))
                        if not len(ends):
                            continue
                        cuts = sliding_window_view(_scaled(x, scalers[k]), shape.length, 0)
                        for at in range(0, len(ends), CHUNK):
                            some = ends[at : at + CHUNK]
                            p = probabilities(shape, vectors.value[k], cuts[some - shape.length + 1].transpose(0, 2, 1))
                            yield pa.RecordBatch.from_arrays([pa.array([series] * len(some), kind), pa.array(some + first), pa.array(np.full(len(some), k, np.int32)), *(pa.array(p[:, i]) for i in range(CLASSES))], [KEY, "seq", "model", *PROBS])

        kind_name = stored.schema[KEY].dataType.simpleString()
        out = stored.mapInArrow(run, f"{KEY} {kind_name}, seq long, model int, {', '.join(f'{p} double' for p in PROBS)}")
        return out.withColumn("pred", argmax(*PROBS))


def class_weights(counts: np.ndarray) -> np.ndarray:
    """Inverse frequency, scaled to sum to the number of classes; the last axis is the class."""
    w = 1.0 / (counts + 1e-6)
    return w / w.sum(-1, keepdims=True) * counts.shape[-1]


def _class_counts(stored: DataFrame, shape: Shape, parts: Parts, models: int) -> np.ndarray:
    def run(batches):
        acc = np.zeros((models, CLASSES))
        for batch in batches:
            for _, _, n, start, first, x, y in _read(batch, shape.features):
                for k, (train, _) in enumerate(parts(n)):
                    acc[k] += np.bincount(y[_ends(n, start, first, len(x), shape.length, train)], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], ["blob"])

    return tree_sum(stored.mapInArrow(run, "blob binary"), models * CLASSES).reshape(models, CLASSES)


def _step(stored: DataFrame, shape: Shape, parts: Parts, vectors: np.ndarray, scalers: np.ndarray, weights: np.ndarray, epoch: int, step: int, how: Training, active: list[int], learn: bool, check: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each active model: its gradient and figures over the step's training windows, its figures over the windows it is
    validated on. One job."""
    size, models = shape.size, len(active)
    sent = stored.sparkSession.sparkContext.broadcast((vectors, scalers, weights))

    def run(batches):
        vectors, scalers, weights = sent.value
        grads, seen, held = np.zeros((models, size)), np.zeros((models, 4)), np.zeros((models, 4))
        for batch in batches:
            for _, block, n, start, first, x, y in _read(batch, shape.features):
                for i, k in enumerate(active):
                    train, val = parts(n)[k]
                    ends = _ends(n, start, first, len(x), shape.length, train) if learn else np.arange(0)
                    if how.steps > 1:
                        ends = ends[_mixed(ends + first, epoch * 7919 + how.seed) % np.uint64(how.steps) == step]
                    checked = _ends(n, start, first, len(x), shape.length, val) if check else np.arange(0)
                    if not len(ends) and not len(checked):
                        continue
                    cuts = sliding_window_view(_scaled(x, scalers[k]), shape.length, 0)
                    rng = np.random.default_rng([how.seed, epoch, step, k, block])
                    for which, into, grad, draw in ((ends, seen, grads[i], rng), (checked, held, None, None)):
                        for at in range(0, len(which), CHUNK):
                            some = which[at : at + CHUNK]
                            into[i] += loss_and_gradient(shape, vectors[k], cuts[some - shape.length + 1].transpose(0, 2, 1), y[some], weights[k], draw, grad)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([grads.ravel(), seen.ravel(), held.ravel()]).tobytes()], pa.binary())], ["blob"])

    got = tree_sum(stored.mapInArrow(run, "blob binary"), models * (size + 8))
    sent.destroy()
    return got[: models * size].reshape(models, size), got[models * size : models * (size + 4)].reshape(models, 4), got[models * (size + 4) :].reshape(models, 4)


class _State:
    """What training has come to: all that the next epoch needs."""

    ARRAYS = ("vectors", "first", "second", "best", "scalers", "weights")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    def save(self, spark: SparkSession, folder: str) -> None:
        info = json.dumps({"epoch": self.epoch, "least": self.least, "waited": self.waited, "updates": self.updates, "history": self.history})
        rows = [(k, *(getattr(self, a)[k].tobytes() for a in self.ARRAYS), info if not k else None) for k in range(len(self.vectors))]
        spark.createDataFrame(rows, f"model int, {', '.join(f'{a} binary' for a in self.ARRAYS)}, info string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch-{self.epoch}")
        for old in finished(spark, folder, "epoch-")[:-2]:
            delete(spark, f"{folder}/epoch-{old}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> _State | None:
        done = finished(spark, folder, "epoch-")
        if not done:
            return None
        rows = spark.read.parquet(f"{folder}/epoch-{done[-1]}").orderBy("model").collect()  # a row for each model
        arrays = {a: np.stack([np.frombuffer(r[a]).copy() for r in rows]) for a in _State.ARRAYS}
        arrays["scalers"] = arrays["scalers"].reshape(len(rows), 2, -1)
        return _State(**arrays, **json.loads(rows[0]["info"]))


def fit(stored: DataFrame, names: list[str], shape: Shape, parts: Parts, how: Training = Training(), folder: str | None = None, scaled: bool = True) -> Fitted:
    """Train all models of `parts` and return each as it was in its best epoch, by the loss on what it is validated on.

    Loss is cross-entropy weighted by inverse class frequency. Steps are those of Adam with decoupled decay, gradients cut
    to a norm of `clip`, on a cosine of rates; a model stops when `patience` epochs brought nothing better. folder: where
    the state of each epoch is kept, and where to go on from; scaled=False: features are taken as they are. A model without
    windows to train on keeps its start; one without windows to be validated on keeps its last epoch.
    """
    spark = stored.sparkSession
    workers_find_us(spark)
    models = len(parts(0))
    ours, folder = folder is None, folder or f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    s = _State.load(spark, folder)
    if s is None:
        scalers = fit_scalers(stored, shape.features, parts, models) if scaled else np.broadcast_to(np.array([[0.0], [1.0]])[None], (models, 2, 1)).repeat(shape.features, -1)
        start = np.stack([shape.start(how.seed) for _ in range(models)])
        weights = class_weights(_class_counts(stored, shape, parts, models))
        s = _State(vectors=start, first=np.zeros_like(start), second=np.zeros_like(start), best=start.copy(), scalers=scalers, weights=weights, epoch=0, least=[None] * models, waited=[0] * models, updates=[0] * models, history=[])
    while s.epoch < how.epochs and (active := [k for k in range(models) if s.waited[k] < how.patience]):
        s.epoch += 1
        rate = how.least_rate + (how.rate - how.least_rate) * (1 + math.cos(math.pi * (s.epoch - 1) / how.period)) / 2
        seen = np.zeros((len(active), 4))
        for step in range(how.steps):
            grads, figures, _ = _step(stored, shape, parts, s.vectors, s.scalers, s.weights, s.epoch, step, how, active, True, False)
            seen += figures
            for i, k in enumerate(active):
                if not figures[i, 1]:
                    continue
                g = grads[i] / figures[i, 1]
                g *= min(1.0, how.clip / (np.linalg.norm(g) + 1e-6))
                s.updates[k] += 1
                s.first[k] = 0.9 * s.first[k] + 0.1 * g
                s.second[k] = 0.999 * s.second[k] + 0.001 * g**2
                move = (s.first[k] / (1 - 0.9 ** s.updates[k])) / (np.sqrt(s.second[k] / (1 - 0.999 ** s.updates[k])) + 1e-8)
                s.vectors[k] = s.vectors[k] * (1 - rate * how.decay) - rate * move
        _, _, held = _step(stored, shape, parts, s.vectors, s.scalers, s.weights, s.epoch, 0, how, active, False, True)
        for i, k in enumerate(active):
            loss = float(held[i, 0] / held[i, 1]) if held[i, 1] else None
            better = loss is None or s.least[k] is None or loss < s.least[k]
            if better:
                s.least[k], s.waited[k], s.best[k] = loss, 0, s.vectors[k]
            else:
                s.waited[k] += 1
            per = lambda f, a, b: float(f[a] / f[b]) if f[b] else None
            s.history.append({"model": k, "epoch": s.epoch, "train_loss": per(seen[i], 0, 1), "train_accuracy": per(seen[i], 2, 3), "val_loss": loss, "val_accuracy": per(held[i], 2, 3), "rate": rate, "best": bool(better)})
        s.save(spark, folder)
    if ours:
        delete(spark, folder)
    return Fitted(shape, names, s.best.copy(), s.scalers, s.history)
