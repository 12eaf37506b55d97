"""Columns that several features build on, in the order in which they can be made."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.frames import finite, lag, lead, ln, mean, ratio, sd, so_far, total, with_blocks
from ...functions.scan import ewm, scans, ta_ema, wilder_mean, wilder_sum

ANNUAL = 252 * 1440


def price_columns(bars: DataFrame) -> DataFrame:
    """Lags, true range, returns, directional moves and typical price."""
    df = with_blocks(bars)
    df = df.withColumns({f"p{c}": lag(c) for c in ("high", "low", "close")} | {"nhigh": lead("high"), "nlow": lead("low"), "filled": F.coalesce(F.last("close", ignorenulls=True).over(so_far()), F.col("filled0"))})
    h, low, c, pc = (F.col(x) for x in ("high", "low", "close", "pclose"))
    rise, fall = h - F.col("phigh"), F.col("plow") - low
    df = df.withColumns(
        {
            "tr": F.greatest(h - low, F.abs(h - pc), F.abs(low - pc)),
            "trange": F.when(pc.isNotNull(), F.greatest(h - low, F.abs(h - pc), F.abs(low - pc))),
            "lr": finite(ln(ratio("close", "pclose"))),
            "diff": c - pc,
            "gain": F.greatest(c - pc, F.lit(0.0)),
            "loss": F.greatest(pc - c, F.lit(0.0)),
            "updm": F.when((rise > 0) & (rise > fall), rise).when(pc.isNotNull(), 0.0),
            "downdm": F.when((fall > 0) & (fall > rise), fall).when(pc.isNotNull(), 0.0),
            "tp": (h + low + c) / 3,
            "lfilled": lag("filled"),
        }
    )
    df = df.withColumn("r", ratio("filled", "lfilled") - 1)
    return df


#: What each family reads of the recurrences.
NEEDS = {
    "price": {"atr14", "ema20", "ema50", "ema200", "e20", "e50", "tr14"},
    "volatility": {"atr14", "atr20", "atr50", "ema20", "rv_ema"},
    "momentum": {"gain7", "gain14", "gain21", "loss7", "loss14", "loss21", "fast", "slow", "dm"},
    "trend": {"atr10", "atr14"},
    "volume": {"tr14"},
}


def recurrences(df: DataFrame, families: set[str]) -> DataFrame:
    """Exponential and Wilder means of prices, ranges, gains and directional moves, as far as families need them."""
    need = set().union(*(NEEDS.get(f, set()) for f in families))
    atrs, emas = ([p for p in of if f"{name}{p}" in need] for name, of in (("atr", (10, 14, 20, 50)), ("ema", (20, 50, 200))))
    rsis = [p for p in (7, 14, 21) if f"gain{p}" in need]
    macd, dm = "fast" in need, "dm" in need
    seeds = {f"m_tr{p}": mean("trange", p) for p in atrs}
    seeds |= {f"m_{x}{p}": mean(x, p) for p in rsis for x in ("gain", "loss")}
    seeds |= {f"m_close{p}": mean("close", p) for p in (*emas, *((12, 26) if macd else ()))}
    if dm:
        seeds |= {f"s_{x}": total(x, 13) for x in ("updm", "downdm", "trange")}
    if "rv_ema" in need:
        seeds["rv30"] = sd("lr", 30) * math.sqrt(ANNUAL)
    if "tr14" in need:
        seeds["tr14"] = mean("tr", 14)
    if seeds:
        df = df.withColumns(seeds)
    todo = [wilder_mean(f"atr{p}", "trange", p, f"m_tr{p}") for p in atrs]
    todo += [wilder_mean(f"{x}{p}", x, p, f"m_{x}{p}") for p in rsis for x in ("gain", "loss")]
    todo += [ta_ema(f"ema{p}", "close", p, f"m_close{p}") for p in emas]
    if macd:
        todo += [ta_ema("fast", "close", 12, "m_close12", start=14), ta_ema("slow", "close", 26, "m_close26")]
    if "e20" in need:
        todo += [ewm("e20", "close", 20), ewm("e50", "close", 50)]
    if dm:
        todo += [wilder_sum(f"w_{x}", x, 14, f"s_{x}") for x in ("updm", "downdm", "trange")]
    if "rv_ema" in need:
        df = df.withColumn("m_rv30", mean("rv30", 50))
        todo.append(ta_ema("rv_ema", "rv30", 50, "m_rv30", start=30))
    if not todo:
        return df
    df = scans(df, *todo)
    made = {f"rsi{p}": F.when(F.col(f"gain{p}") + F.col(f"loss{p}") == 0, 0.0).otherwise(100 * F.col(f"gain{p}") / (F.col(f"gain{p}") + F.col(f"loss{p}"))) for p in rsis}
    if "e20" in need:
        made["cross"] = F.col("e20") - F.col("e50")
    if macd:
        made["macd"] = F.col("fast") - F.col("slow")
    if dm:
        whole = F.col("w_trange")
        made |= {f"di_{s}": F.when(F.col("seq") >= 14, F.when(whole == 0, 0.0).otherwise(100 * F.col(f"w_{x}") / whole)) for s, x in (("up", "updm"), ("down", "downdm"))}
    if made:
        df = df.withColumns(made)
    if not (macd and dm):
        return df
    both = F.col("di_up") + F.col("di_down")
    df = df.withColumn("dx", F.when(both == 0, 0.0).otherwise(100 * F.abs(F.col("di_up") - F.col("di_down")) / both))
    df = df.withColumns({"m_macd": mean("macd", 9), "m_dx": mean("dx", 14)})
    return scans(df, ta_ema("signal", "macd", 9, "m_macd", start=25), wilder_mean("adx", "dx", 14, "m_dx", start=14))
