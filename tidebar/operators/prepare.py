"""From a feature table to samples: cleaning, splits, folds, scaling, sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType

from ..functions.frames import KEY, STRETCH, in_stretches, of_series, rows, with_blocks
from ..functions.quantiles import matrices, quantiles
from ..functions.store import Scratch, fold_far_repeats
from ..sources.bars import number_rows

EXCLUDED = {"series_id", "seq", "ts", "utc", "open", "high", "low", "close", "volume", "label_primary", "label_meta"}
CORE = ("atr_14", "rsi_14", "ema_slope_20", "log_return", "close_position")


def feature_columns(df: DataFrame, excluded: set[str] = frozenset(EXCLUDED)) -> list[str]:
    """Numeric columns that are not excluded."""
    return [f.name for f in df.schema if f.name not in excluded and isinstance(f.dataType, (DoubleType, FloatType, IntegerType, LongType))]


def present(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))


def drop_empty(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """df without those of the named columns that hold nothing, and the names left; one pass over df."""
    if not names:
        return df, []
    counts = df.agg(*[F.count(F.when(present(n), 1)).alias(n) for n in names]).first()
    gone = [n for n in names if not counts[n]]
    return df.drop(*gone), [n for n in names if n not in gone]


def renumber(df: DataFrame) -> DataFrame:
    """seq without gaps, in the order of seq."""
    order = df.withColumnRenamed("seq", "_was")
    return number_rows(order, [KEY], [F.col("_was")], F.floor(F.col("_was") / 65536)).drop("_was")


def clean(df: DataFrame, core: tuple[str, ...] = CORE) -> tuple[DataFrame, list[str]]:
    """Rows that have all core features, without empty features, gaps filled with 0; bars are numbered anew.

    As later steps look at neighbouring rows, a bar without range, whose close_position is null, is gone from them.
    """
    df, names = drop_empty(df, feature_columns(df))
    for n in core:
        if n in names:
            df = df.where(present(n))
    numbers = [n for n in names if dict(df.dtypes)[n] in ("double", "float")]
    return renumber(df.fillna(0.0, numbers).fillna(0, [n for n in names if n not in numbers])), names


def _counted(df: DataFrame) -> DataFrame:
    """df with _n, the rows of its series: an aggregate sent to all tasks, so that no series has to be in one task."""
    return df.join(F.broadcast(df.groupBy(KEY).agg(F.count("*").alias("_n"))), KEY).select(*df.columns, "_n")


def time_split(df: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """df with part: train, val or test, by position."""
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(val))
    part = F.when(F.col("seq") < a, "train").when(F.col("seq") < a + b, "val").otherwise("test")
    return _counted(df).withColumn("part", part).drop("_n")


def time_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """A row for each fold a bar is in: fold, role (train or test), seq_in_fold of test rows.

    Blocks of n // (folds + 1) rows at the end are test blocks; a fold trains on all rows before its block.
    """
    fold = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    df = _counted(df).withColumn("_size", F.floor(F.col("_n") / (folds + 1))).withColumn("fold", fold)
    start = F.col("_n") - (folds + 1 - F.col("fold")) * F.col("_size")
    df = df.withColumn("_start", start).where(F.col("seq") < F.col("_start") + F.col("_size"))
    inside = F.col("seq") >= F.col("_start")
    return df.withColumns({"role": F.when(inside, "test").otherwise("train"), "seq_in_fold": F.when(inside, F.col("seq") - F.col("_start"))}).drop("_size", "_n", "_start")


def fit_scaler(train: DataFrame, names: list[str]) -> DataFrame:
    """feature, median, iqr: exact quartiles over the rows given, which must be training rows; an iqr of 0 counts as 1.

    The columns are stored once, and histograms of all of them refined in passes over that; no task holds a column's values.
    Missing values count as greater than all others; a column without rows has neither median nor iqr.
    """
    with Scratch() as scratch:
        stored = scratch.keep(train.select(*[F.col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)]))
        q = quantiles(stored, matrices([f"c{i}" for i in range(len(names))]), 1, len(names), (0.25, 0.5, 0.75))[0]
    number = lambda x: None if np.isnan(x) else float(x)
    rows = [(n, number(m), number((b - a) or 1.0)) for n, (a, m, b) in zip(names, q)]
    return train.sparkSession.createDataFrame(rows, "feature string, median double, iqr double")


def scale(df: DataFrame, params: DataFrame | dict[str, tuple[float, float]], names: list[str]) -> DataFrame:
    """(x - median) / iqr for the named columns; what is not finite becomes 0. Prices stay as they are."""
    if isinstance(params, DataFrame):
        params = {r["feature"]: (r["median"], r["iqr"]) for r in params.collect()}  # a row for each feature
    out = {}
    for n in names:
        median, iqr = params[n]
        x = (F.col(n) - F.lit(median)) / F.lit(iqr)
        out[n] = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return df.withColumns(out)


def with_window(df: DataFrame, length: int) -> DataFrame:
    """Rows of df that have a whole window of `length` rows behind them: all but the first length - 1 of a series, whatever
    its numbers."""
    placed = number_rows(df.withColumnRenamed("seq", "_was"), [KEY], [F.col("_was")], F.floor(F.col("_was") / STRETCH))
    return placed.where(F.col("seq") >= length - 1).drop("seq").withColumnRenamed("_was", "seq").select(*df.columns)


def sequences(df: DataFrame, names: list[str], length: int = 60, step: int = 1, cls: str | None = None, task_rows: int = STRETCH) -> DataFrame:
    """series_id, seq, x (array of `length` arrays of features, float) and the class of the last bar.

    Rows are numbered from 0 without gaps; a task has a stretch of `task_rows` and the length - 1 rows before it.
    Windows lie in order, each but one bar the one before it, so that as Parquet they take little more than their bars.
    """
    fold_far_repeats(df.sparkSession)
    df = with_blocks(in_stretches(df, task_rows, back=length - 1)).withColumn("_x", F.array(*[F.col(n).cast("float") for n in names]))
    out = df.withColumn("x", F.collect_list("_x").over(rows(length))).where((F.col("seq") >= length - 1) & ((F.col("seq") - length + 1) % step == 0))
    return of_series(out.withColumnRenamed(cls, "y") if cls else out, KEY, "seq", "x", *(["y"] if cls else []))
