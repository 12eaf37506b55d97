"""Momentum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.frames import finite, flag, highest, lag, lowest, mean, rows

c = F.col


def prepare() -> dict[str, Column]:
    span = highest("high", 14) - lowest("low", 14)
    return {
        "_k": F.when(span == 0, 0.0).otherwise(100 * (c("close") - lowest("low", 14)) / span),
        "_w": F.when(span == 0, 0.0).otherwise(-100 * (highest("high", 14) - c("close")) / span),
        "_tp14": mean("tp", 14),
        "_tp50": mean("tp", 50),
        "_tps14": F.collect_list("tp").over(rows(14)),
        "_tps50": F.collect_list("tp").over(rows(50)),
        "_hist": F.when(c("signal").isNotNull(), c("macd") - c("signal")),
    }


def _roc(n: int) -> Column:
    was = lag("close", n)
    return F.when(was == 0, 0.0).otherwise(100 * (c("close") / was - 1))


def _cci(n: int) -> Column:
    m = c(f"_tp{n}")
    apart = F.aggregate(f"_tps{n}", F.lit(0.0), lambda a, x: a + F.abs(x - m)) / n
    return F.when(m.isNotNull(), F.when(apart == 0, 0.0).otherwise((c("tp") - m) / (0.015 * apart)))


def first() -> dict[str, Column]:
    both = c("di_up") + c("di_down")
    return {
        "rsi_7": c("rsi7"),
        "rsi_14": c("rsi14"),
        "rsi_21": c("rsi21"),
        "rsi_divergence": flag((c("close") > highest("close", 5, -1)) & (c("rsi14") < highest("rsi14", 5, -1))),
        "_slow": mean("_k", 3),
        "macd_line": F.when(c("signal").isNotNull(), c("macd")),
        "macd_signal": c("signal"),
        "macd_histogram": c("_hist"),
        "macd_hist_slope": c("_hist") - lag("_hist", 3),
        "roc_5": _roc(5),
        "roc_10": _roc(10),
        "roc_20": _roc(20),
        "williams_r": c("_w"),
        "cci_14": _cci(14),
        "cci_50": _cci(50),
        "adx_14": c("adx"),
        "di_plus": c("di_up"),
        "di_minus": c("di_down"),
        "dx_cross": finite((c("di_up") - c("di_down")) / F.nullif(both, F.lit(0.0))),
    }


def second() -> dict[str, Column]:
    d = mean("_slow", 3)
    return {"stoch_k": F.when(d.isNotNull(), c("_slow")), "stoch_d": d}
