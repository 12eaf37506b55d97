"""From bars to signals: extraction, training, inference, walk-forward evaluation.

Stage 1 is the window network, stage 2 trees grown leaf by leaf; networks that differ in their rows only (folds, walk-forward
windows) are trained together.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import KEY
from ..functions.store import Scratch, keep
from ..operators import evaluate as E
from ..operators import leafwise
from ..operators import prepare as P
from ..operators import sequence_training as S
from ..operators.attention import Shape
from ..operators.features import ALL, features
from ..operators.labels import add_labels, class_of
from ..sources.bars import OHLCV, TIMEFRAMES, read_bars, write_table


@dataclass(frozen=True)
class Config:
    """What a run can be told; importing it touches nothing."""

    label_method: str = "triple_barrier"
    sequence_length: int = 60
    train: float = 0.70
    val: float = 0.15
    folds: int = 5
    default_tau: float = 0.55
    tune_tau: bool = True
    base_lot: float = 1.0
    max_mult: float = 2.0
    wanted: list[str] = field(default_factory=lambda: list(ALL))
    width: int = 128
    heads: int = 8
    layers: int = 4
    inner: int = 256
    dropout: float = 0.1
    training: S.Training = S.Training()
    growth: leafwise.Growth = leafwise.Growth()

    def shape(self, features: int) -> Shape:
        return Shape(features, self.sequence_length, self.width, self.heads, self.layers, self.inner, self.dropout)


def extract(bars: DataFrame, path: str, wanted: list[str] | None = None, skip_existing: bool = True, fmt: str = "parquet", chunk_rows: int | None = None) -> None:
    """Write the feature table of bars; what is already there stays, if told so."""
    write_table(features(bars, wanted, chunk_rows), path, fmt, "ignore" if skip_existing else "overwrite")


def extract_timeframes(spark: SparkSession, folder: str, out: str, frames: dict[str, str] = TIMEFRAMES, wanted: list[str] | None = None, skip_existing: bool = True) -> None:
    """A feature table in `out` for each time frame's bar file in `folder`."""
    for name, file in frames.items():
        extract(read_bars(spark, f"{folder}/{file}"), f"{out}/{name}", wanted, skip_existing)


def read_features(spark: SparkSession, path: str, names: list[str] = ALL, fmt: str = "parquet") -> DataFrame:
    """A stored feature table with the bars' columns and the named features, in the types that later steps need.

    A column that is missing or holds no numbers is an error that names it; further columns are left out.
    """
    reader = spark.read.format(fmt).option("header", True)
    df = reader.load(path)
    types = {KEY: "string", "seq": "long", "ts": "timestamp", **{c: "double" for c in (*OHLCV, *names)}}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    if missing := [n for n in types if n not in have]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    numbers = ("double", "float", "int", "bigint", "smallint", "tinyint", *(("string",) if fmt == "csv" else ()))
    if wrong := [n for n, t in types.items() if t == "double" and have[n] not in numbers and not have[n].startswith("decimal")]:
        raise ValueError(f"no numbers in {', '.join(wrong)}")
    return df.select(*[(F.col(n).try_cast(t) if have[n] == "string" else F.col(n).cast(t)).alias(n) for n, t in types.items()])


def prepare(table: DataFrame, config: Config) -> tuple[DataFrame, list[str]]:
    """Cleaned features with labels and class y, and the names of the features."""
    df, names = P.clean(table)
    return add_labels(df, config.label_method).withColumn("y", class_of(F.col("label_primary"))), names


def _with_returns(df: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predictions with the change of the unscaled close to the next bar; NaN on the last predicted row of each series, as the
    bar behind it belongs to another part."""
    last = predicted.groupBy(KEY).agg(F.max("seq").alias("_last"))
    both = predicted.join(E.next_return(df.select(KEY, "seq", "close")).select(KEY, "seq", "ret"), [KEY, "seq"]).join(F.broadcast(last), KEY)
    return both.withColumn("ret", F.when(F.col("seq") == F.col("_last"), float("nan")).otherwise(F.col("ret"))).drop("_last")


@dataclass
class Trained:
    names: list[str]
    network: S.Fitted
    meta: leafwise.Boosted
    tau: float

    @property
    def sequence_length(self) -> int:
        return self.network.shape.length

    @property
    def meta_names(self) -> list[str]:
        return [*self.names, *E.PROBS, "pred", "margin"]

    @property
    def scaler(self) -> dict[str, tuple[float, float]]:
        median, iqr = self.network.scalers[0]
        return {n: (float(m), float(i)) for n, m, i in zip(self.names, median, iqr)}

    def save(self, spark: SparkSession, path: str) -> None:
        self.network.save(spark, f"{path}/primary")
        self.meta.save(spark, f"{path}/meta")
        params = [(n, *v) for n, v in self.scaler.items()]
        spark.createDataFrame(params, "feature string, median double, iqr double").write.mode("overwrite").parquet(f"{path}/scaler")
        spark.createDataFrame([(json.dumps({"features": self.names, "tau": self.tau}),)], "value string").write.mode("overwrite").text(f"{path}/info")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trained:
        info = json.loads(spark.read.text(f"{path}/info").first()[0])
        return Trained(info["features"], S.Fitted.load(spark, f"{path}/primary"), leafwise.Boosted.load(spark, f"{path}/meta"), info["tau"])

    def score(self, df: DataFrame, stored: DataFrame, part: Callable[[int], tuple[int, int]] | None = None, true: str | None = None) -> DataFrame:
        """Rows with predictions of both stages, from a window's length on. part: the rows, by the number of rows of a series,
        that windows must lie in."""
        p = self.network.predict(stored, (lambda n: [((0, 0), part(n))]) if part else None, [0]).drop("model")
        return self.judge(df, p, true)

    def judge(self, df: DataFrame, p: DataFrame, true: str | None = None) -> DataFrame:
        """Stage 2 for rows of df that have predictions p of stage 1."""
        both = P.scale(df, self.scaler, self.names).join(p, [KEY, "seq"])
        inputs = E.meta_inputs(both, self.names, true)
        kept = both.select(KEY, "seq", "ts", *([true] if true else []))
        return self.meta.predict(inputs).join(kept, [KEY, "seq"])


#: For each model the end of its training rows and of those it is validated on, by the number of rows of a series.
Cuts = Callable[[int], list[tuple[int, int]]]


def train_many(df: DataFrame, names: list[str], config: Config, cuts: Cuts, scratch: Scratch, folder: str | None = None) -> tuple[list[Trained], DataFrame]:
    """Both stages and the threshold for each of the cuts, and the stored blocks; the networks and their folds in one training.

    df: cleaned rows with class y, numbered from 0 without gaps, stored. Stage 2 learns from out-of-fold predictions; tau is
    tuned on validation rows; scalers see training rows only. folder: where the networks' epochs are kept, to go on from.
    """
    each = 1 + config.folds

    def parts(n: int):
        out = []
        for a, b in cuts(n):
            size = a // (config.folds + 1)
            starts = [a - (config.folds + 1 - k) * size for k in range(1, config.folds + 1)]
            out += [((0, a), (a, b)), *(((0, s), (s, s + size)) for s in starts)]
        return out

    stored = S.blocks(df, names, "y", config.sequence_length)
    scratch.frames.append(stored)
    fitted = S.fit(stored, names, config.shape(len(names)), parts, config.training, folder)
    predicted = scratch.keep(fitted.predict(stored, parts))
    out = []
    for k in range(len(parts(0)) // each):
        at = k * each
        one = S.Fitted(fitted.shape, names, fitted.vectors[at : at + 1], fitted.scalers[at : at + 1], [{**h, "model": 0} for h in fitted.history if h["model"] == at])
        made = Trained(list(names), one, None, config.default_tau)
        held = F.col("model") == at
        p = predicted.where(F.col("model").between(at, at + config.folds)).withColumn("held", held).drop("model")
        both = P.scale(df, made.scaler, names).join(p, [KEY, "seq"])
        rows = scratch.keep(E.meta_inputs(both, [*names, "held"], "y"))
        made.meta = leafwise.fit(rows, made.meta_names, how=config.growth)
        if config.tune_tau:
            checked = predicted.where(held).drop("model")
            judged = scratch.keep(_with_returns(df, made.judge(df, checked, "y")))  # the sweep reads it several times
            made.tau = E.best_tau(E.sweep(judged), config.default_tau)
        out.append(made)
    return out, stored


def run_train(table: DataFrame, config: Config = Config(), folder: str | None = None) -> tuple[Trained, DataFrame]:
    """Train on a feature table and report on its last part. folder: of a run that was stopped, to go on from."""
    df, names = prepare(table, config)
    bounds = lambda n: (math.floor(n * config.train), math.floor(n * config.train) + math.floor(n * config.val))
    with Scratch() as scratch:
        df = scratch.keep(df)
        (made,), stored = train_many(df, names, config, lambda n: [bounds(n)], scratch, folder)
        scored = made.score(df, stored, lambda n: (bounds(n)[1], n), "y")
        report = keep(E.report(scratch.keep(_with_returns(df, scored)), made.tau))  # read for each figure
    return made, report


def training_history(made: Trained) -> DataFrame:
    """model, epoch, losses, accuracies, rate and whether the epoch was the best so far, of stage 1."""
    return made.network.history_table(SparkSession.active())


def run_inference(table: DataFrame, made: Trained, config: Config = Config()) -> DataFrame:
    """Signals for a feature table; features that the model lacks are left out, missing ones are an error."""
    if missing := [n for n in made.names if n not in table.columns]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    df = table.select(KEY, "seq", "ts", *OHLCV, *made.names)
    for n in P.CORE:
        if n in made.names:
            df = df.where(F.col(n).isNotNull())
    with Scratch() as scratch:
        df = scratch.keep(P.renumber(df.fillna(0.0)))
        stored = S.blocks(df.withColumn("y", F.lit(0)), made.names, "y", made.sequence_length)
        scratch.frames.append(stored)
        return keep(E.signal_table(made.score(df, stored), made.tau, config.base_lot, config.max_mult))


def run_walk_forward(table: DataFrame, config: Config = Config(), windows: int = 5, least_train: int = 600, least_test: int = 120) -> DataFrame:
    """A row for each window, everything fitted anew in each, and their mean; one series. The networks of all windows, and of
    their folds, are trained together."""
    df, names = prepare(table, config)
    with Scratch() as scratch:
        df = scratch.keep(df)
        n = df.count()
        folds = E.walk_forward_folds(n, windows, least_train=least_train, least_test=least_test)
        if not folds:
            raise ValueError("too few rows for any window")
        models, stored = train_many(df, names, config, lambda _: [(f.val_start, f.train_end) for f in folds], scratch)
        out = None
        for fold, made in zip(folds, models):
            scored = made.score(df, stored, lambda _, f=fold: (f.train_end, f.test_end), "y")
            got = E.figures(scratch.keep(_with_returns(df, scored)), made.tau)  # read for each figure
            row = got.select(
                F.lit(fold.window_id).alias("window_id"), F.lit(fold.train_end).cast("long").alias("train_size"), F.lit(fold.test_end - fold.train_end).cast("long").alias("test_size"), "n_trades",
                *[F.round(F.coalesce(c, F.lit(0.0)), d).alias(n) for c, n, d in (("win_rate", "win_rate", 4), ("sharpe", "sharpe", 4), ("cum_return", "cum_return", 6), ("max_drawdown", "max_drawdown", 6), ("s1_accuracy", "s1_accuracy", 4), ("auc", "meta_auc", 4))],
                F.round("tau", 3).alias("tau"),
            )
            out = row if out is None else out.unionByName(row)
        return keep(E.with_mean_row(scratch.keep(out)))
