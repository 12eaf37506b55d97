"""Volume."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.frames import corr, finite, lag, mean, ratio, rows, sd, so_far

c = F.col


def _all(x: Column, carried: str) -> Column:
    """Running sum from the first bar on."""
    here = F.sum(F.when(c("_use"), x)).over(so_far())
    return F.coalesce(here + c(carried), here, c(carried))


def prepare() -> dict[str, Column]:
    flow = c("tp") * c("volume")
    ptp = lag("tp")
    clv = ((c("close") - c("low")) - (c("high") - c("close"))) / F.nullif(c("high") - c("low"), F.lit(0.0))
    return {
        "_pos": F.when(c("tp") > ptp, flow).otherwise(0.0),
        "_neg": F.when(c("tp") < ptp, flow).otherwise(0.0),
        "_obv": F.coalesce(F.signum("diff"), F.lit(0.0)) * c("volume"),
        "_adl": F.coalesce(clv, F.lit(0.0)) * c("volume"),
        "_v20": mean("volume", 20),
        "_ar": F.abs(c("r")),
        "_vwap": _all(flow, "flow0") / F.nullif(_all(c("volume"), "volume0"), F.lit(0.0)),
    }


def first() -> dict[str, Column]:
    pos, neg = F.sum("_pos").over(rows(14)), F.sum("_neg").over(rows(14))
    mfi = F.when(neg > 0, 100 - 100 / (1 + pos / neg)).when(pos > 0, 100.0)
    both = F.when(c("volume").isNotNull() & c("_ar").isNotNull(), 1)
    return {
        "volume_sma_ratio": finite(ratio("volume", "_v20")),
        "volume_zscore": finite(ratio(c("volume") - mean("volume", 50), sd("volume", 50))),
        "volume_trend": (c("_v20") - lag("_v20", 5)) / 5,
        "obv_slope": F.when(c("seq") >= 20, F.sum("_obv").over(rows(20)) / 20),
        "mfi_14": F.when(F.count("tp").over(rows(14)) == 14, mfi),
        "vwap_distance": finite(ratio(c("close") - c("_vwap"), c("tr14"))),
        "volume_price_corr": F.when(F.count(both).over(rows(20)) == 20, corr("volume", "_ar", 20)),
        "accumulation_dist": F.when(c("seq") >= 20, F.sum("_adl").over(rows(20)) / 20),
    }
