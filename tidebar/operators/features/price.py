"""Price action."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.frames import finite, flag, highest, lag, lowest, ratio, rows, sd, so_far, mean

c = F.col


def _span() -> Column:
    return F.nullif(c("high") - c("low"), F.lit(0.0))


def breaks(way: int) -> Column:
    """Whether a bar ends a run of closes that go one way (1 up, -1 down)."""
    goes = c("close") > c("pclose") if way > 0 else c("close") < c("pclose")
    return ~F.coalesce(goes, F.lit(False))


def _run(way: int, carried: str) -> Column:
    """Bars since the last one that breaks the run."""
    here = F.max(F.when(c("_use") & breaks(way), c("seq"))).over(so_far())
    return (c("seq") - F.coalesce(here, c(carried))).cast("double")


def swing() -> Column:
    """The extreme of a swing bar; the low where it is both."""
    high = (c("high") > c("phigh")) & (c("high") > c("nhigh"))
    low = (c("low") < c("plow")) & (c("low") < c("nlow"))
    return F.when(low, c("low")).when(high, c("high"))


def first() -> dict[str, Column]:
    return {
        "log_return": c("lr"),
        "abs_return": F.abs(c("lr")),
        "high_low_range": finite((c("high") - c("low")) / F.nullif(F.avg("tr").over(rows(14)), F.lit(0.0))),
        "close_position": (c("close") - c("low")) / _span(),
        "body_ratio": F.abs(c("close") - c("open")) / _span(),
        "upper_wick_ratio": (c("high") - F.greatest("open", "close")) / _span(),
        "lower_wick_ratio": (F.least("open", "close") - c("low")) / _span(),
        "gap": c("open") - c("pclose"),
        "consecutive_up": _run(1, "up0"),
        "consecutive_down": _run(-1, "down0"),
        "bar_return_zscore": finite(ratio(mean("r", 20), sd("r", 20))),
        "price_vs_ema20": finite(ratio(c("close") - c("ema20"), c("atr14"))),
        "price_vs_ema50": finite(ratio(c("close") - c("ema50"), c("atr14"))),
        "price_vs_ema200": finite(ratio(c("close") - c("ema200"), c("atr14"))),
        "ema_cross_20_50": finite(ratio(c("cross"), sd("cross", 20))),
        "ema_slope_20": (c("e20") - lag("e20", 5)) / 5,
        "higher_high": flag(c("high") > highest("high", 5, -1)),
        "lower_low": flag(c("low") < lowest("low", 5, -1)),
        "_swing": F.coalesce(F.last(F.when(c("_use"), swing()), ignorenulls=True).over(so_far()), c("swing0")),
    }


def second() -> dict[str, Column]:
    return {"swing_strength": finite(ratio(F.abs(c("close") - c("_swing")), c("tr14")))}


