"""Affine recurrences y[t] = a y[t-1] + b[t] as window functions, without Python and without a join.

Rows of a block are summed with weights a^-i, block ends are carried on within a superblock the same way, and
superblock ends by a few lags, as many as it takes for a^rows to fall below 1e-18. Blocks are cut by seq, the same
for all recurrences, so any number of them shares the windows; b is 0 before a recurrence's seed row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import B, block, series, superblock

TINY = -math.log(1e-18)


@dataclass(frozen=True)
class Scan:
    """Column `name` = the recurrence with factor a over column `b`, null before seq `seed`."""

    name: str
    a: float
    b: Column
    seed: int


def seeded(seed_row: int, seed: Column, then: Column) -> Column:
    """b: 0 before the seed row, the seed there, `then` after it; a gap in the input counts as 0."""
    return F.when(F.col("seq") < seed_row, 0.0).when(F.col("seq") == seed_row, F.coalesce(seed, F.lit(0.0))).otherwise(F.coalesce(then, F.lit(0.0)))


def scans(df: DataFrame, *wanted: Scan) -> DataFrame:
    """df with each recurrence; they may not build on one another."""
    i, j = F.col("seq") % B, F.col("blk") % B
    so_far, all_of = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, Window.unboundedFollowing)
    before = (Window.unboundedPreceding, -1)

    def power(a: float, n: Column) -> Column:
        return F.pow(F.lit(a), n)

    made = [f"_{s.name}_{x}" for s in wanted for x in "bledcg"]
    df = df.withColumns({f"_{s.name}_b": s.b for s in wanted})
    df = df.withColumns({f"_{s.name}_l": power(s.a, i) * F.sum(F.col(f"_{s.name}_b") * power(s.a, -i)).over(block().rowsBetween(*so_far)) for s in wanted})
    df = df.withColumns({f"_{s.name}_e": F.last(f"_{s.name}_l").over(block().rowsBetween(*all_of)) for s in wanted})
    ends = F.when(i == B - 1, F.lit(True))
    df = df.withColumns({f"_{s.name}_d": F.sum(F.when(ends, F.col(f"_{s.name}_e") * power(s.a**B, -j))).over(superblock().rowsBetween(*before)) for s in wanted})
    df = df.withColumns({f"_{s.name}_c": F.coalesce(F.col(f"_{s.name}_d") * power(s.a**B, j - 1), F.lit(0.0)) for s in wanted})
    df = df.withColumns({f"_{s.name}_g": F.last(F.col(f"_{s.name}_e") + F.col(f"_{s.name}_c") * s.a**B).over(superblock().rowsBetween(*all_of)) for s in wanted})

    def value(s: Scan) -> Column:
        rows = B * B
        carry = F.lit(0.0)
        for q in range(1, max(1, math.ceil(TINY / (-rows * math.log(s.a)))) + 1):
            carry = carry + F.coalesce(F.lag(f"_{s.name}_g", rows * q).over(series()), F.lit(0.0)) * s.a ** (rows * (q - 1))
        y = F.col(f"_{s.name}_l") + power(s.a, i + 1) * (F.col(f"_{s.name}_c") + power(s.a**B, j) * carry)
        return F.when(F.col("seq") >= s.seed, y)

    return df.withColumns({s.name: value(s) for s in wanted}).drop(*made)


def ewm(name: str, x: str, span: int) -> Scan:
    """Exponential mean with factor 2 / (span + 1) from the first value on."""
    k = 2 / (span + 1)
    return Scan(name, 1 - k, seeded(0, F.col(x), k * F.col(x)), 0)


def ta_ema(name: str, x: str, period: int, seed_mean: str, start: int = 0) -> Scan:
    """The same, from the mean of the first `period` values (column seed_mean there), which begin at row `start`."""
    k, row = 2 / (period + 1), start + period - 1
    return Scan(name, 1 - k, seeded(row, F.col(seed_mean), k * F.col(x)), row)


def wilder_mean(name: str, x: str, period: int, seed_mean: str, start: int = 1) -> Scan:
    """y[t] = (y[t-1] (p - 1) + x[t]) / p from the mean of the first p values, which begin at row `start`."""
    row = start + period - 1
    return Scan(name, 1 - 1 / period, seeded(row, F.col(seed_mean), F.col(x) / period), row)


def wilder_sum(name: str, x: str, period: int, seed_sum: str) -> Scan:
    """y[t] = y[t-1] - y[t-1] / p + x[t] from the sum of the first p - 1 values, which begin at row 1."""
    return Scan(name, 1 - 1 / period, seeded(period - 1, F.col(seed_sum), F.col(x)), period - 1)
