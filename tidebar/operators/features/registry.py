"""The registry of features, and the plan that computes any of them.

A series is cut into stretches, each behind the rows that its windows and recurrences reach back to and before the one
that a swing looks ahead to, so that a long series is many tasks. What reaches back without bound (running sums,
run lengths, last events) is carried into each stretch from a small table of all stretches. Values are those of one pass
over the whole series.

Everything but the statistics of returns is a stack of window expressions over one partitioning and one ordering; a
query that asks for a few features keeps only the windows these need, as the optimizer drops expressions that nothing
reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.frames import KEY, STRETCH, finite, flag, in_stretches, mean, ratio
from ...functions.ranks import rolling_percentile
from ...sources.bars import OHLCV
from . import momentum, price, session, statistical, trend, volatility, volume
from .base import price_columns, recurrences

FAMILIES = {"price": price, "volatility": volatility, "momentum": momentum, "trend": trend, "statistical": statistical, "volume": volume, "session": session}
PERCENTILE_WINDOW = 252 * 1440
#: Rows of a stretch, and how far back windows and recurrences of a family reach: there a^rows is below 1e-18, so nothing is lost.
TASK_ROWS = STRETCH
REACH = {"price": 5120, "volatility": 3072, "momentum": 2048}
#: The names, by family, in the order of registration.
FEATURES: dict[str, list[str]] = {
    "price": [
        "log_return",
        "abs_return",
        "high_low_range",
        "close_position",
        "body_ratio",
        "upper_wick_ratio",
        "lower_wick_ratio",
        "gap",
        "consecutive_up",
        "consecutive_down",
        "bar_return_zscore",
        "price_vs_ema20",
        "price_vs_ema50",
        "price_vs_ema200",
        "ema_cross_20_50",
        "ema_slope_20",
        "higher_high",
        "lower_low",
        "swing_strength",
    ],
    "volatility": [
        "atr_14",
        "atr_50",
        "atr_ratio",
        "realized_vol_10",
        "realized_vol_30",
        "realized_vol_60",
        "parkinson_vol",
        "garman_klass_vol",
        "yang_zhang_vol",
        "vol_of_vol",
        "vol_zscore",
        "vol_percentile",
        "bollinger_width",
        "keltner_width",
        "natr",
        "vol_regime_ma",
        "vol_breakout",
        "vol_contraction",
    ],
    "momentum": [
        "rsi_7",
        "rsi_14",
        "rsi_21",
        "rsi_divergence",
        "stoch_k",
        "stoch_d",
        "macd_line",
        "macd_signal",
        "macd_histogram",
        "macd_hist_slope",
        "roc_5",
        "roc_10",
        "roc_20",
        "williams_r",
        "cci_14",
        "cci_50",
        "adx_14",
        "di_plus",
        "di_minus",
        "dx_cross",
    ],
    "trend": [
        "linear_reg_slope_20",
        "linear_reg_slope_50",
        "linear_reg_r2_20",
        "linear_reg_r2_50",
        "supertrend",
        "ichimoku_tk_cross",
        "ichimoku_cloud_dist",
        "aroon_up",
        "aroon_down",
        "aroon_oscillator",
        "vortex_plus",
        "vortex_minus",
    ],
    "statistical": [
        "rolling_skew_30",
        "rolling_skew_60",
        "rolling_kurtosis_30",
        "rolling_kurtosis_60",
        "entropy_30",
        "hurst_100",
        "autocorr_1",
        "autocorr_5",
        "autocorr_10",
        "partial_autocorr_1",
        "variance_ratio",
        "adf_pvalue_100",
        "jarque_bera",
        "rolling_median_dev",
        "quantile_range",
    ],
    "volume": [
        "volume_sma_ratio",
        "volume_zscore",
        "volume_trend",
        "obv_slope",
        "mfi_14",
        "vwap_distance",
        "volume_price_corr",
        "accumulation_dist",
    ],
    "session": [
        "hour_sin",
        "hour_cos",
        "minute_sin",
        "minute_cos",
        "day_of_week_sin",
        "day_of_week_cos",
        "is_asian_session",
        "is_london_session",
        "is_newyork_session",
        "is_overlap_ln",
        "minutes_into_session",
        "minutes_to_close",
    ],
}
ALL = [n for names in FEATURES.values() for n in names]
#: What is made of returns over missing closes, which need the last close before a stretch.
OF_RETURNS = {"bar_return_zscore", "bar_return_2score", "volume_price_corr", "jarque_bera_60", *FEATURES["statistical"]}


def _variants() -> dict[str, Column]:
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return {
        "lower_wick_ratio_raw": finite(F.least("open", "close") / span),
        "bar_return_2score": F.col("bar_return_zscore"),
        "consecutive_up_int": F.col("consecutive_up").cast("int"),
        "consecutive_down_int": F.col("consecutive_down").cast("int"),
        "vol_contraction_strict": flag(F.col("atr14") < 0.5 * F.col("atr50")),
        "volume_sma_ratio_raw": ratio("volume", mean("volume", 20)),
    }


#: Named variants of features that differ in a detail, with their family.
VARIANT_OF = {
    "lower_wick_ratio_raw": "price",
    "bar_return_2score": "price",
    "consecutive_up_int": "price",
    "consecutive_down_int": "price",
    "vol_contraction_strict": "volatility",
    "volume_sma_ratio_raw": "volume",
    "jarque_bera_60": "statistical",
}
VARIANTS = list(VARIANT_OF)


def in_chunks(bars: DataFrame, rows: int, warm_up: int) -> DataFrame:
    """Bars of each chunk of `rows`, behind the last `warm_up` ones of the chunk before, as series of their own.

    Columns _series, _seq and _own (false for warm-up rows) lead back. This is both how a long series is spread
    over tasks and how extraction by chunks behaves, where recurrences and running sums start anew.
    """
    chunk = F.floor(F.col("seq") / rows)
    both = F.when(F.col("seq") % rows >= rows - warm_up, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    df = bars.withColumn("_at", F.explode(both))
    start = F.when(F.col("_at") > 0, F.col("_at") * rows - warm_up).otherwise(0)
    return df.select(
        F.struct(F.col(KEY).alias("series"), F.col("_at").alias("chunk")).alias(KEY),
        (F.col("seq") - start).alias("seq"),
        *[c for c in df.columns if c not in (KEY, "seq", "_at")],
        F.col(KEY).alias("_series"),
        F.col("seq").alias("_seq"),
        (chunk == F.col("_at")).alias("_own"),
    )


def _ending(name: str) -> Column:
    """The last value of a column in the own rows of a stretch."""
    return F.max_by(name, F.when(F.col("_own") & F.col(name).isNotNull(), F.col("seq")))


#: What a feature carries into a stretch from those before it.
CARRY = {"vwap_distance": ("flow0", "volume0"), "consecutive_up": ("up0",), "consecutive_down": ("down0",), "swing_strength": ("swing0",), "supertrend": ("turn0",)}


def _in_stretch() -> dict[str, Column]:
    """What there is of it in one stretch: a sum or a last value."""
    own = lambda x: F.when(F.col("_own"), x)
    return {
        "flow0": F.sum(own(F.col("tp") * F.col("volume"))),
        "volume0": F.sum(own(F.col("volume"))),
        "up0": F.max(own(F.when(price.breaks(1), F.col("seq")))),
        "down0": F.max(own(F.when(price.breaks(-1), F.col("seq")))),
        "swing0": _ending("_swing1"),
        "turn0": _ending("_turn1"),
    }


def _carry(df: DataFrame, wanted: list[str], rows: int, reach: int) -> DataFrame:
    """Stretches with what is carried into each. filled0 is the last close before the first row of a stretch."""
    made = {n: _in_stretch()[n] for f, names in CARRY.items() if f in wanted for n in names}
    out = price_columns(df.withColumn("filled0", F.lit(None).cast("double")))
    if "swing_strength" in wanted:
        out = out.withColumn("_swing1", price.swing())
    if "supertrend" in wanted:
        out = recurrences(out, {"trend"})
        out = out.withColumns(trend.bands()).withColumn("_turn1", trend.turn())
    early = F.col("_own") & (F.col("seq") < (F.col(f"{KEY}.stretch") + 1) * rows - reach)
    ends = {"close_all": _ending("close"), "close_early": F.max_by("close", F.when(early & F.col("close").isNotNull(), F.col("seq")))}
    per = out.groupBy(KEY).agg(*[x.alias(n) for n, x in {**ends, **made}.items()])
    order = Window.partitionBy(f"{KEY}.series").orderBy(f"{KEY}.stretch")
    before, long_before = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, -2)
    filled = F.coalesce(F.lag("close_early").over(order), F.last("close_all", ignorenulls=True).over(long_before))
    carried = [(F.sum(n) if n in CARRY["vwap_distance"] else F.last(n, ignorenulls=True)).over(before).alias(n) for n in made]
    return per.select(KEY, filled.alias("filled0"), *carried)


def features(bars: DataFrame, wanted: list[str] | None = None, chunk_rows: int | None = None, warm_up: int = 500, percentile_window: int = PERCENTILE_WINDOW, task_rows: int | None = TASK_ROWS, on_error: str = "raise") -> DataFrame:
    """bars (series_id, seq, ts, open ... volume) and the wanted features, all 104 unless told.

    task_rows: rows of a series that are one task's, a multiple of 1024; None for a whole series. chunk_rows: instead compute
    chunk by chunk with `warm_up` rows of the chunk before, which other than a whole pass restarts recurrences, running sums
    and run lengths there. on_error="null": a feature that can't be made (one of your own, or a statistic in a stretch) is
    null and the others stay. vol_percentile needs a full window of volatilities: it is null in series shorter than
    `percentile_window` and 14 rows.
    """
    if on_error not in ("raise", "null"):
        raise ValueError("on_error is raise or null")
    wanted = ALL + list(CUSTOM) if wanted is None else wanted
    if unknown := [n for n in wanted if n not in ALL and n not in VARIANTS and n not in CUSTOM]:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    if task_rows and task_rows % 1024:
        raise ValueError("task_rows must be a multiple of 1024")
    if chunk_rows:
        parts = features(in_chunks(bars, chunk_rows, warm_up), wanted, None, warm_up, percentile_window, None, on_error).where("_own")
        return parts.select(F.col("_series").alias(KEY), F.col("_seq").alias("seq"), "ts", *OHLCV, *wanted)
    kept = bars.columns
    families = {f for f, names in FEATURES.items() if set(names) & set(wanted)} | {VARIANT_OF[n] for n in wanted if n in VARIANTS} | {CUSTOM[n][0] for n in wanted if n in CUSTOM}
    if families <= {"session"} and not set(wanted) & set(CUSTOM):  # of a row alone
        return bars.withColumns(session.first()).select(*kept, *wanted)
    needed = {{"consecutive_up_int": "consecutive_up", "consecutive_down_int": "consecutive_down"}.get(n, n) for n in wanted}
    df = plain = bars
    if "vol_percentile" in wanted:  # made first, so that its join moves bars, not rows of features, and no feature is made twice
        df = rolling_percentile(features(bars, ["atr_14"], task_rows=task_rows), "atr_14", percentile_window, "vol_percentile", task_rows or TASK_ROWS).select(*kept, "vol_percentile")
    if task_rows:
        reach = max((REACH.get(f, 1024) for f in families), default=1024)
        reach += 1024 * max((-(-(CUSTOM[n][2] - 100) // 1024) for n in wanted if n in CUSTOM), default=0)
        df, plain = in_stretches(df, task_rows, reach, 1), in_stretches(plain, task_rows, reach, 1)
        if needed & (OF_RETURNS | set(CARRY) | set(CUSTOM)):
            df = df.join(_carry(plain, needed, task_rows, reach), KEY)
        df = df.withColumn("_use", F.col("_own"))
    else:
        df = df.withColumn("_use", F.lit(True))
    df = df.withColumns({n: F.lit(None).cast("double") for n in ("filled0", *(x for names in CARRY.values() for x in names)) if n not in df.columns})
    df = recurrences(price_columns(df), families)
    for step in ("prepare", "first", "second", "third"):
        made = {n: x for f in FAMILIES if f in families and hasattr(FAMILIES[f], step) for n, x in getattr(FAMILIES[f], step)().items()}
        if made:
            df = df.withColumns(made)
    returns = [n for n in statistical.MADE if n in wanted or n == "jarque_bera" and "jarque_bera_60" in wanted]
    if set(VARIANTS) & set(wanted):
        df = df.withColumns({n: x for n, x in _variants().items() if n in wanted and n != "jarque_bera_60"})
    for n in (n for n in wanted if n in CUSTOM):
        try:
            df = df.withColumn(n, CUSTOM[n][1]())
        except Exception:
            if on_error != "null":
                raise
            df = df.withColumn(n, F.lit(None).cast("double"))
    if returns:
        names = [*kept, *(n for n in wanted if n in df.columns and n not in kept), *(n for n in ("_series", "_own") if n in df.columns and n not in kept), *({"r", "atr14"} & set(df.columns))]
        df = statistical.compute(df.select(*names), returns, on_error)
        if "jarque_bera_60" in wanted:
            df = df.withColumn("jarque_bera_60", F.col("jarque_bera"))
    if task_rows:
        df = df.where("_own").withColumn(KEY, F.col("_series"))
    return df.select(*kept, *wanted)


#: Features that users add: name -> (family whose columns it builds on, what makes it, rows it looks back).
CUSTOM: dict[str, tuple[str, Callable[[], Column], int]] = {}


def register(name: str, family: str, make: Callable[[], Column], reach: int = 100) -> None:
    """Add a feature of one's own: a column over those of a family, whose windows reach back `reach` rows at the most."""
    if name in ALL or name in VARIANTS or family not in FAMILIES:
        raise ValueError(f"{name} is taken, or {family} no family")
    CUSTOM[name] = (family, make, reach)
