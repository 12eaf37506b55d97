"""Trend.

Rolling frames are the cost here: a frame of n rows is gone through anew for each row. Extremes over 26 and 52 rows are
thus put together from those over 9 by lags, fits over n consecutive rows take a covariance and a mean, and whether
a window varies at all is told by its last change.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.frames import finite, full, highest, lag, lowest, mean, ratio, rows, so_far, total

c = F.col


def bands() -> dict[str, Column]:
    half = (c("high") + c("low")) / 2
    return {"_above": half + 3 * c("atr10"), "_below": half - 3 * c("atr10")}


def turn() -> Column:
    return F.when(c("close") > lag("_above"), 1.0).when(c("close") < lag("_below"), -1.0)


def _slope(n: int) -> Column:
    """Slope of close over seq, whose variance over n consecutive rows is (n^2 - 1) / 12."""
    return full(F.covar_pop("close", "seq"), "close", n) / ((n * n - 1) / 12)


def _place(x: Column) -> Column:
    """The largest x of 9 rows and its last place."""
    return full(F.max(F.struct(x.alias("x"), c("seq"))), x, 9)


def _widest(extreme, x: str, *back: int) -> Column:
    """The extreme over adjoining or overlapping frames that end at this row and `back` rows before it; null unless all are full."""
    parts = [c(x), *[lag(x, k) for k in back]]
    there = c(x).isNotNull()
    for part in parts[1:]:
        there = there & part.isNotNull()
    return F.when(there, extreme(*parts))


def prepare() -> dict[str, Column]:
    return {
        "linear_reg_slope_20": _slope(20),
        "linear_reg_slope_50": _slope(50),
        "_mean20": mean("close", 20),
        "_mean50": mean("close", 50),
        "_step": F.when(c("close") != c("pclose"), c("seq")),
        **bands(),
        "_high9": highest("high", 9),
        "_low9": lowest("low", 9),
        "_up9": _place(c("high")),
        "_down9": _place(-c("low")),
        "_vp": F.abs(c("high") - c("plow")),
        "_vm": F.abs(c("low") - c("phigh")),
    }


def _aroon(x: str) -> Column:
    return 100.0 * (25 - (c("seq") - _widest(F.greatest, x, 9, 17)["seq"])) / 25


def first() -> dict[str, Column]:
    return {
        "_lr20": c("_mean20") + c("linear_reg_slope_20") * 9.5,
        "_lr50": c("_mean50") + c("linear_reg_slope_50") * 24.5,
        "_turn": turn(),
        "_high26": _widest(F.greatest, "_high9", 9, 17),
        "_low26": _widest(F.least, "_low9", 9, 17),
        "aroon_up": _aroon("_up9"),
        "aroon_down": _aroon("_down9"),
        "vortex_plus": finite(ratio(total("_vp", 14), total("trange", 14))),
        "vortex_minus": finite(ratio(total("_vm", 14), total("trange", 14))),
    }


def second() -> dict[str, Column]:
    return {
        "supertrend": F.coalesce(F.last(F.when(c("_use"), c("_turn")), ignorenulls=True).over(so_far()), c("turn0")),
        "_high52": _widest(F.greatest, "_high26", 26),
        "_low52": _widest(F.least, "_low26", 26),
        "_step20": F.when(c("_lr20") != lag("_lr20"), c("seq")),
        "_step50": F.when(c("_lr50") != lag("_lr50"), c("seq")),
        "aroon_oscillator": c("aroon_up") - c("aroon_down"),
    }


def _r2(n: int) -> Column:
    """Squared correlation of close and the end of its fit over n rows, all there; 0 where one of the two doesn't vary."""
    x = f"_lr{n}"
    varied = F.lit(True)
    for step in ("_step", f"_step{n}"):
        varied = varied & (F.last(step, ignorenulls=True).over(so_far()) >= c("seq") - (n - 2))
    spread = F.nullif(F.stddev_pop("close").over(rows(n)) * F.stddev_pop(x).over(rows(n)), F.lit(0.0))
    r = F.coalesce(F.when(varied, F.covar_pop("close", x).over(rows(n)) / spread), F.lit(0.0))
    return F.when(c(x).isNotNull() & lag(x, n - 1).isNotNull(), r * r)


def third() -> dict[str, Column]:
    m9, m26, m52 = ((c(f"_high{n}") + c(f"_low{n}")) / 2 for n in (9, 26, 52))
    return {
        "linear_reg_r2_20": _r2(20),
        "linear_reg_r2_50": _r2(50),
        "ichimoku_tk_cross": finite(ratio(m9 - m26, c("atr14"))),
        "ichimoku_cloud_dist": finite(ratio(c("close") - ((m9 + m26) / 2 + m52) / 2, c("atr14"))),
    }
