"""Volatility."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.frames import finite, flag, full, ln, mean, ratio, sd
from .base import ANNUAL

c = F.col


def _root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def prepare() -> dict[str, Column]:
    hl, co = ln(ratio("high", "low")), ln(ratio("close", "open"))
    ho, lo = ln(ratio("high", "open")), ln(ratio("low", "open"))
    return {
        "_pk": hl * hl,
        "_gk": 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co,
        "_yz": F.pow(ln(ratio("open", "pclose")), F.lit(2.0)) + ho * (ho - co) + lo * (lo - co),
    }


def first() -> dict[str, Column]:
    year = math.sqrt(ANNUAL)
    return {
        "atr_14": c("atr14"),
        "atr_50": c("atr50"),
        "atr_ratio": finite(ratio("atr14", "atr50")),
        "realized_vol_10": sd("lr", 10) * year,
        "realized_vol_30": c("rv30"),
        "realized_vol_60": sd("lr", 60) * year,
        "parkinson_vol": F.sqrt(full(F.sum("_pk"), "_pk", 30) / (4 * 30 * math.log(2))),
        "garman_klass_vol": _root(mean("_gk", 30)),
        "yang_zhang_vol": _root(mean("_yz", 30)),
        "vol_zscore": finite(ratio(c("atr14") - mean("atr14", 100), sd("atr14", 100))),
        "bollinger_width": finite(ratio(4 * full(F.stddev_pop("close"), "close", 20), mean("close", 20))),
        "keltner_width": finite(ratio(4 * c("atr20"), c("ema20"))),
        "natr": 100 * ratio("atr14", "close"),
        "vol_regime_ma": c("rv_ema"),
        "vol_breakout": flag(c("atr14") > 2 * c("atr50")),
        "vol_contraction": flag(c("atr14") <= 0.5 * c("atr50")),
    }


def second() -> dict[str, Column]:
    return {"vol_of_vol": sd("realized_vol_10", 20)}
