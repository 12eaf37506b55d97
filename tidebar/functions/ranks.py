"""Rank of each value in the window of rows that ends at it, for windows of any length, over many tasks.

A series is stored as stretches of values. A task takes one stretch and as many before it as the window spans, cuts them
into sorted blocks, and counts a row's smaller and equal values by binary searches in the blocks that lie within its window
and by comparison with the rows of the two blocks that stick out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import KEY
from .store import workers_find_us

STRETCH = 65_536
BLOCK = 2048


def window_ranks(x: np.ndarray, start: int, window: int, block: int = BLOCK) -> np.ndarray:
    """Percentile ranks, ties averaged, of x[start:] each among the `window` values up to it; NaN unless all are there."""
    n = len(x)
    gaps = np.concatenate([[0], np.isnan(x).cumsum()])
    rows = np.arange(n)
    full = (rows >= window - 1) & (gaps[rows + 1] == gaps[np.maximum(rows + 1 - window, 0)])
    if not full[start:].any():
        return np.full(n - start, np.nan)
    block = max(1, min(block, window // 4))
    less, upto = np.zeros(n), np.zeros(n)
    for a in range(0, n, block):
        b = min(a + block, n)
        part = np.sort(x[a:b])
        low, high = max(start, b - 1), min(n, a + window)
        if b - a == block and low < high:  # rows whose window holds the block
            less[low:high] += np.searchsorted(part, x[low:high], "left")
            upto[low:high] += np.searchsorted(part, x[low:high], "right")
        ends = np.arange(max(a, start), min(b if b - a < block else b - 1, n))  # rows that end within the block
        first = np.arange(max(a + window, start), min(b + window - 1, n))  # rows whose window begins within it
        for at, inside in ((ends, lambda i: np.arange(a, b) <= i[:, None]), (first, lambda i: np.arange(a, b) > i[:, None] - window)):
            if len(at):
                mine, held = x[at][:, None], inside(at)
                less[at] += ((x[a:b] < mine) & held).sum(1)
                upto[at] += ((x[a:b] <= mine) & held).sum(1)
    return np.where(full, (less + (upto - less + 1) / 2) / window, np.nan)[start:]


def rolling_percentile(df: DataFrame, column: str, window: int, name: str, stretch: int = STRETCH, block: int = BLOCK) -> DataFrame:
    """df with the percentile rank, ties averaged, of each row's value among the last `window` rows; null unless all are there.

    df has series_id and seq, each number of a series once; numbers that are left out count as missing values. A task holds
    the values of a stretch and a window, whatever the length of a series.
    """
    workers_find_us(df.sparkSession)
    kind = df.schema[KEY].dataType.simpleString()
    at = F.floor(F.col("seq") / stretch)

    def pack(some: pd.DataFrame) -> pd.DataFrame:
        first = int(some["_at"].iloc[0]) * stretch
        values = np.full(stretch, np.nan)
        values[some["seq"].to_numpy() - first] = some[column].to_numpy(np.float64)
        return pd.DataFrame({KEY: some[KEY].iloc[:1], "_at": some["_at"].iloc[:1], "_values": [values.tobytes()], "_end": [int(some["seq"].max()) - first + 1]})

    packed = df.select(KEY, "seq", F.col(column).cast("double").alias(column), at.alias("_at")).groupBy(KEY, "_at").applyInPandas(pack, f"{KEY} {kind}, _at long, _values binary, _end long")
    spans = -(-(window - 1) // stretch)
    sent = packed.withColumn("_to", F.explode(F.sequence(F.col("_at"), F.col("_at") + spans)))

    def rank(some: pd.DataFrame) -> pd.DataFrame:
        to = int(some["_to"].iloc[0])
        own = some[some["_at"] == to]
        if own.empty:
            return pd.DataFrame({KEY: some[KEY].iloc[:0], "seq": np.zeros(0, np.int64), name: np.zeros(0)})
        x = np.full(stretch * (spans + 1), np.nan)
        for at, values in zip(some["_at"], some["_values"]):
            x[(int(at) - to + spans) * stretch :][:stretch] = np.frombuffer(values)
        end = int(own["_end"].iloc[0])
        skip = max(0, stretch * spans - window + 1)
        ranks = window_ranks(x[skip : stretch * spans + end], stretch * spans - skip, window, block)
        return pd.DataFrame({KEY: [own[KEY].iloc[0]] * end, "seq": np.arange(end) + to * stretch, name: ranks})

    ranks = sent.groupBy(KEY, "_to").applyInPandas(rank, f"{KEY} {kind}, seq long, {name} double").where(F.col(name).isNotNull() & ~F.isnan(name))
    return df.join(ranks, [KEY, "seq"], "left")
