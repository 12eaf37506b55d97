"""Statistics of returns. Windows are complete: none has a value before its last return has come.

A stretch of a series is one pass of numpy over all its windows at once, as views of one array of returns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from ...functions.adf import adf_pvalues
from ...functions.frames import KEY
from ...functions.store import workers_find_us

HURST_LAGS = range(2, 20)
#: Rows whose windows are looked at together.
STEP = 4096


def moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Population variance, skewness and excess kurtosis of each row; the last two are NaN for constant rows."""
    d = w - w.mean(1, keepdims=True)
    var = (d * d).mean(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        skew, kurt = (d**3).mean(1) / var**1.5, (d**4).mean(1) / var**2 - 3
    flat = np.ptp(w, axis=1) == 0
    skew[flat] = kurt[flat] = np.nan
    return np.where(flat, 0.0, var), skew, kurt


def entropy(w: np.ndarray) -> np.ndarray:
    """Of ten equal bins between least and greatest; 0 for constant rows."""
    low, span = w.min(1, keepdims=True), np.ptp(w, axis=1)[:, None]
    place = np.minimum(np.floor(10 * (w - low) / np.where(span > 0, span, 1)), 9).astype(np.int64)
    counts = np.bincount((place + 10 * np.arange(len(w))[:, None]).ravel(), minlength=10 * len(w)).reshape(-1, 10)
    p = counts / w.shape[1]
    return np.where(span[:, 0] > 0, -(p * np.log(np.where(p > 0, p, 1))).sum(1), 0.0)


def hurst(w: np.ndarray) -> np.ndarray:
    """Slope of log spread of differences over log lag."""
    x = np.log(np.array(HURST_LAGS))
    weight = (x - x.mean()) / ((x - x.mean()) ** 2).sum()
    return sum(k * np.log(np.maximum((w[:, lag:] - w[:, :-lag]).std(1), 1e-10)) for lag, k in zip(HURST_LAGS, weight))


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows; NaN where one is constant."""
    x, y = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    scale = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    varied = (np.ptp(a, axis=1) > 0) & (np.ptp(b, axis=1) > 0) & (scale > 0)
    return np.where(varied, (x * y).sum(1) / np.where(varied, scale, 1), np.nan)


def partial(w: np.ndarray) -> np.ndarray:
    """First partial autocorrelation, adjusted: (n / (n - 1)) sum (x_t - m)(x_t+1 - m) / sum (x - m)^2."""
    n = w.shape[1]
    d = w - w.mean(1, keepdims=True)
    whole = np.where(np.ptp(w, axis=1) > 0, (d * d).sum(1), np.nan)
    return n / (n - 1) * (d[:, 1:] * d[:, :-1]).sum(1) / whole


def variance_ratio(w: np.ndarray) -> np.ndarray:
    """Variance of the sums of pairs that tile the window, over twice that of its returns."""
    return (w[:, ::2] + w[:, 1::2]).var(1) / np.where(np.ptp(w, axis=1) > 0, 2 * w.var(1), np.nan)


def median_deviation(w: np.ndarray) -> np.ndarray:
    return np.median(np.abs(w - np.median(w, axis=1, keepdims=True)), axis=1)


def jarque_bera(w: np.ndarray) -> np.ndarray:
    _, skew, kurt = moments(w)
    return 10 * (skew * skew + kurt * kurt / 4)


def quantile_range(w: np.ndarray) -> np.ndarray:
    low, high = np.quantile(w, [0.25, 0.75], axis=1)
    return high - low


#: name -> returns of a window, and what is made of windows (a row each).
MADE: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray]]] = {
    "rolling_skew_30": (30, lambda w: moments(w)[1]),
    "rolling_skew_60": (60, lambda w: moments(w)[1]),
    "rolling_kurtosis_30": (30, lambda w: moments(w)[2]),
    "rolling_kurtosis_60": (60, lambda w: moments(w)[2]),
    "entropy_30": (30, entropy),
    "hurst_100": (100, hurst),
    "autocorr_1": (50, lambda w: correlation(w[:, 1:], w[:, :-1])),
    "autocorr_5": (50, lambda w: correlation(w[:, 5:], w[:, :-5])),
    "autocorr_10": (50, lambda w: correlation(w[:, 10:], w[:, :-10])),
    "partial_autocorr_1": (50, partial),
    "variance_ratio": (60, variance_ratio),
    "adf_pvalue_100": (100, adf_pvalues),
    "jarque_bera": (60, jarque_bera),
    "rolling_median_dev": (60, median_deviation),
    "quantile_range": (60, quantile_range),
}


def over_windows(r: np.ndarray, n: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """make() of the n values that end at each row of r; NaN where not all are there."""
    out = np.full(len(r), np.nan)
    if len(r) < n:
        return out
    views = np.lib.stride_tricks.sliding_window_view(r, n)
    missing = np.concatenate(([0], np.cumsum(~np.isfinite(r))))
    whole = np.flatnonzero(missing[n:] == missing[:-n])
    for at in range(0, len(whole), STEP):
        rows = whole[at : at + STEP]
        out[rows + n - 1] = make(views[rows])
    return out


def compute(df: DataFrame, wanted: list[str], on_error: str = "raise") -> DataFrame:
    """df with the wanted features of column r, stretch by stretch of its key; what fails is null if on_error says so."""
    workers_find_us(df.sparkSession)
    schema = StructType([*df.schema, *(StructField(n, DoubleType()) for n in wanted)])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("seq")
        r = part.column("r").to_numpy().astype(np.float64)
        for n in wanted:
            try:
                made = over_windows(r, *MADE[n])
            except (ArithmeticError, ValueError, np.linalg.LinAlgError):
                if on_error != "null":
                    raise
                made = np.full(len(r), np.nan)
            part = part.append_column(n, pa.array(made, from_pandas=True))
        return part

    return df.groupBy(KEY).applyInArrow(run, schema)
