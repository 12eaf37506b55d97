"""Labels that look forward: triple barrier, fixed horizon, and whether a prediction came true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import STRETCH, in_stretches, lead, of_series, with_blocks

CLASS_NAMES = ("SHORT", "FLAT", "LONG")


def triple_barrier(df: DataFrame, tp_mult: float = 1.5, sl_mult: float = 1.0, max_hold: int = 12, name: str = "label_primary", task_rows: int = STRETCH) -> DataFrame:
    """1 if within max_hold bars the close first rises by tp_mult * atr_14, -1 if it first falls by sl_mult * atr_14, else 0.

    Barriers are on closes and those of a long position. Without a volatility above 0, and in the last max_hold + 1
    rows of a series, the label is 0. atr_14 is required. Rows are numbered without gaps; a task has a stretch of
    `task_rows` and the rows behind it that it looks ahead to.
    """
    if "atr_14" not in df.columns:
        raise ValueError("triple-barrier labels need atr_14")
    atr, close = F.col("atr_14"), F.col("close")
    df = with_blocks(in_stretches(df, task_rows, ahead=max_hold + 1))
    steps = [F.when(lead("close", j) - close >= tp_mult * atr, 1).when(lead("close", j) - close <= -sl_mult * atr, -1) for j in range(1, max_hold + 1)]
    label = F.when((atr > 0) & lead(F.lit(True), max_hold + 1).isNotNull(), F.coalesce(*steps, F.lit(0))).otherwise(0)
    return of_series(df.withColumn(name, label.cast("tinyint")))


def fixed_horizon(df: DataFrame, horizon: int = 3, flat_band: float = 0.0003, name: str = "label_primary", task_rows: int = STRETCH) -> DataFrame:
    """Sign of the return over `horizon` bars outside a band; 0 within it and for the last rows. Tasks are stretches of rows."""
    ahead = lead("close", horizon) / F.nullif(F.col("close"), F.lit(0.0)) - 1
    df = with_blocks(in_stretches(df, task_rows, ahead=horizon))
    return of_series(df.withColumn(name, F.when(ahead > flat_band, 1).when(ahead < -flat_band, -1).otherwise(0).cast("tinyint")))


def add_labels(df: DataFrame, method: str = "triple_barrier") -> DataFrame:
    """Labels by the named method, with default parameters."""
    methods = {"triple_barrier": triple_barrier, "fixed_horizon": fixed_horizon}
    if method not in methods:
        raise ValueError(f"no label method {method}")
    return methods[method](df)


def class_of(label: Column) -> Column:
    """-1, 0, 1 as class 0, 1, 2; anything else as 1."""
    return F.when(label.isin(-1, 0, 1), label + 1).otherwise(1).cast("int")


def label_of(cls: Column) -> Column:
    return (cls - 1).cast("int")


def class_name(cls: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASS_NAMES)), cls + 1)


def meta_label(pred: Column, true: Column) -> Column:
    """1 where the predicted class was right."""
    return (pred == true).cast("tinyint")


def label_counts(df: DataFrame, label: str = "label_primary") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, cls: str = "y", classes: int = 3) -> DataFrame:
    """weight of each class: inverse frequency, scaled to sum to the number of classes."""
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(cls))
    counts = every.join(df.groupBy(cls).agg(F.count("*").alias("n")), cls, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inverse = counts.withColumn("w", 1.0 / (F.col("n") + 1e-6))
    return inverse.select(cls, "n", (F.col("w") / F.sum("w").over(Window.partitionBy()) * classes).alias("weight"))
