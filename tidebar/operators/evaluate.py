"""Two-stage signals: meta inputs, gate, size, returns, threshold sweep, metrics, walk-forward windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import KEY, STRETCH, in_stretches, lead, of_series, with_blocks

ANNUAL = 252 * 1440
PROBS = ("p_short", "p_flat", "p_long")
NAN = float("nan")
#: Bands of probabilities, and rows of a series, within which running figures are taken in one task.
BANDS, BLOCK = 4096, 4096


def argmax(*columns: str) -> Column:
    """Index of the largest, the first of equal ones."""
    values = F.array(*columns)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_two_margin(*columns: str) -> Column:
    ordered = F.sort_array(F.array(*columns), asc=False)
    return ordered[0] - ordered[1]


def meta_inputs(df: DataFrame, names: list[str], true: str | None = None) -> DataFrame:
    """Features, probabilities, predicted class and margin of rows that have a prediction; y_meta if the class is known."""
    out = df.where(F.col("pred") >= 0).withColumn("margin", top_two_margin(*PROBS))
    if true:
        out = out.withColumn("y_meta", (F.col("pred") == F.col(true)).cast("tinyint"))
    return out.select(KEY, "seq", *names, *PROBS, "pred", "margin", *(["y_meta"] if true else []))


def gate(pred: Column, prob: Column, tau: Column | float) -> Column:
    """The predicted class where it isn't flat and the meta probability reaches tau, else flat (1)."""
    return F.when((pred != 1) & (prob >= tau), pred).otherwise(1)


def taken(prob: Column, tau: float = 0.66) -> Column:
    """The plain filter of batch scoring: above tau, whatever the direction."""
    return prob > tau


def position_size(prob: Column, signal: Column, tau: float, base_lot: float = 1.0, max_mult: float = 2.0) -> Column:
    """base_lot, rising to max_mult times it as the probability goes from tau to 1; 0 for flat."""
    edge = F.least(F.greatest((prob - tau) / (1 - tau + 1e-9), F.lit(0.0)), F.lit(1.0))
    return F.when(signal == 1, 0.0).otherwise(base_lot * (1 + edge * (max_mult - 1))).cast("float")


def next_return(df: DataFrame, name: str = "ret", task_rows: int = STRETCH) -> DataFrame:
    """Change of the close to the next bar; NaN, not null, on the last one, so that it shows in what includes it.

    Rows are numbered without gaps; tasks are stretches of `task_rows`.
    """
    df = with_blocks(in_stretches(df, task_rows, ahead=1))
    return of_series(df.withColumn(name, F.coalesce(lead("close") - F.col("close"), F.lit(NAN))))


def pnl(signal: Column, ret: Column) -> Column:
    """Class 0 sells, 1 stands aside, 2 buys."""
    return (signal - 1) * ret


def sharpe(x: str | Column) -> Column:
    return F.avg(x) / (F.stddev_pop(x) + 1e-9) * F.sqrt(F.lit(float(ANNUAL)))


def thresholds(spark: SparkSession, start: float = 0.40, step: float = 0.01, count: int = 46) -> DataFrame:
    return spark.range(count).select(F.col("id").cast("int").alias("i"), (F.lit(start) + F.col("id") * F.lit(step)).alias("cut"))


def sweep(df: DataFrame, least: int = 10) -> DataFrame:
    """tau, precision, recall, f1, sharpe, n_trades for 46 thresholds over rows with meta_prob, y_meta, pred and ret.

    A row counts for every threshold up to its probability. Rather than pair rows with thresholds, sums are taken
    once for each number of thresholds reached, and added up from the highest down; flat predictions are in the
    returns with 0. With fewer than `least` rows the figures are NaN; f1 is that of the rows picked, all of which
    count as positive.
    """
    spark = df.sparkSession
    cuts = [0.40 + i * 0.01 for i in range(46)]
    reached = sum((F.when(F.col("meta_prob") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    gain = pnl(F.col("pred"), F.col("ret"))
    of = df.select(reached.alias("k"), F.col("y_meta").cast("double").alias("y"), gain.alias("g"))
    # Sums and squares about the mean of all finite gains, which keeps the variance exact enough.
    mid = of.agg(F.avg(F.when(~F.isnan("g"), F.col("g"))).alias("mid"))
    parts = of.crossJoin(mid).groupBy("k").agg(
        F.count("*").alias("n"), F.sum("y").alias("hits"), F.sum(F.col("g") - F.col("mid")).alias("s"), F.sum(F.pow(F.col("g") - F.col("mid"), F.lit(2.0))).alias("q"), F.first("mid").alias("mid")
    )
    total = parts.agg(F.sum("hits").alias("all_hits"), F.first("mid").alias("m"))
    got = (
        thresholds(spark).join(parts, F.col("k") > F.col("i"), "left").groupBy("i", "cut")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_trades"), F.sum("hits").alias("hits"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        .crossJoin(total)
    )
    n, enough = F.col("n_trades"), F.col("n_trades") >= least
    precision = F.col("hits") / n
    mean = F.col("m") + F.col("s") / n
    spread = F.sqrt(F.greatest(F.col("q") / n - F.pow(F.col("s") / n, F.lit(2.0)), F.lit(0.0)))
    ratio = mean / (spread + 1e-9) * F.sqrt(F.lit(float(ANNUAL)))

    def shown(x: Column) -> Column:
        return F.when(enough, F.round(x, 4)).otherwise(F.lit(NAN))

    return got.select(
        F.when(enough, F.round("cut", 2)).otherwise(F.col("cut")).alias("tau"),
        shown(precision).alias("precision"),
        shown(F.when(F.col("all_hits") > 0, F.col("hits") / F.col("all_hits")).otherwise(0.0)).alias("recall"),
        shown(F.when(F.col("hits") > 0, 2 * precision / (precision + 1)).otherwise(0.0)).alias("f1"),
        F.when(enough, F.when(F.isnan(ratio), NAN).otherwise(F.round(ratio, 4))).otherwise(F.lit(NAN)).alias("sharpe"),
        n.alias("n_trades"),
    )


def best_tau(swept: DataFrame, default: float = 0.55) -> float:
    """The threshold with the best Sharpe ratio (rounded), the lowest of equal ones; `default` if there is none."""
    row = swept.where(~F.isnan("sharpe")).orderBy(F.desc("sharpe"), "tau").first()
    return row["tau"] if row else default


def best_thresholds(swept: DataFrame, n: int = 5) -> DataFrame:
    return swept.where(~F.isnan("sharpe")).orderBy(F.desc("sharpe"), "tau").limit(n)


def roc_auc(df: DataFrame, prob: str, label: str) -> DataFrame:
    """auc: the share of (positive, negative) pairs that are in order, ties half; null unless both occur.

    Rows are first counted by distinct probability; running counts are taken within bands of it, and over the bands.
    """
    by = df.groupBy(F.col(prob).alias("_prob")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_n"))
    band = F.when(F.isnan("_prob"), BANDS + 1).otherwise(F.floor(F.least(F.greatest("_prob", F.lit(0.0)), F.lit(1.0)) * BANDS))
    by = by.withColumn("_band", F.coalesce(band, F.lit(-1)))
    before = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    starts = by.groupBy("_band").agg(F.sum("_n").alias("_all")).select("_band", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    below = Window.partitionBy("_band").orderBy("_prob").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("_in", F.coalesce(F.sum("_n").over(below), F.lit(0))).join(starts, "_band")
    pairs = F.sum("_p") * F.sum("_n")
    return by.agg((F.sum(F.col("_p") * (F.col("_start") + F.col("_in") + F.col("_n") / 2.0)) / F.nullif(pairs.cast("double"), F.lit(0.0))).alias("auc"))


def accuracy(pred: str, true: str) -> Column:
    return F.avg((F.col(pred) == F.col(true)).cast("double"))


def trade_metrics(df: DataFrame, signal: str = "signal", size: str = "size", ret: str = "ret") -> DataFrame:
    """n_rows, n_trades, win_rate, sharpe, cum_return, max_drawdown of sized trades, in order of seq; one series.

    The running maximum starts at the first trade's result. Without trades all but the counts are null; a NaN return
    makes what includes it NaN, and is no win.
    """
    trades = df.where(F.col(signal) != 1).select("seq", (pnl(F.col(signal), F.col(ret)) * F.col(size)).alias("g"))
    run = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = trades.withColumn("block", F.floor(F.col("seq") / BLOCK)).withColumn("cum", F.sum("g").over(run)).withColumn("drop", F.max("cum").over(run) - F.col("cum"))
    blocks = inside.groupBy("block").agg(F.sum("g").alias("sum"), F.max("cum").alias("top"), F.min("cum").alias("low"), F.max("drop").alias("drop"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0.0))).withColumn("peak", F.max(F.col("start") + F.col("top")).over(before))
    worst = blocks.agg(F.max(F.greatest("drop", F.col("peak") - F.col("start") - F.col("low"))).alias("max_drawdown"))
    figures = trades.agg(
        F.count("*").alias("n_trades"),
        F.avg(((F.col("g") > 0) & ~F.isnan("g")).cast("double")).alias("win_rate"),
        sharpe("g").alias("sharpe"),
        F.sum("g").alias("cum_return"),
    )
    return df.agg(F.count("*").alias("n_rows")).crossJoin(figures).crossJoin(worst)  # tables of one row


def with_signals(df: DataFrame, tau: float) -> DataFrame:
    """df with signal and size, from pred and meta_prob."""
    out = df.withColumn("signal", gate(F.col("pred"), F.col("meta_prob"), F.lit(tau)))
    return out.withColumn("size", position_size(F.col("meta_prob"), F.col("signal"), tau))


# Names of the report's figures, with the digits they are rounded to.
REPORT = (
    ("Stage1_Accuracy_Unfiltered", "s1_accuracy", 4),
    ("Meta_AUC", "auc", 4),
    ("Tau", "tau", None),
    ("N_Trades", "n_trades", None),
    ("Trade_Rate_pct", "trade_rate", 2),
    ("Win_Rate", "win_rate", 4),
    ("Sharpe_Annualised", "sharpe", 3),
    ("Cumulative_Return", "cum_return", 4),
    ("Max_Drawdown", "max_drawdown", 4),
)


def figures(df: DataFrame, tau: float) -> DataFrame:
    """One row: the trade metrics at tau, s1_accuracy, auc, trade_rate (percent) and tau."""
    one = trade_metrics(with_signals(df, tau)).crossJoin(df.agg(accuracy("pred", "y").alias("s1_accuracy"))).crossJoin(roc_auc(df, "meta_prob", "y_meta"))
    return one.withColumn("trade_rate", 100.0 * F.col("n_trades") / F.nullif(F.col("n_rows"), F.lit(0))).withColumn("tau", F.lit(tau))


def report(df: DataFrame, tau: float) -> DataFrame:
    """metric, value: nine figures of combined signals over rows with pred, y, meta_prob, y_meta, ret; null for none."""

    def shown(column: str, digits: int | None) -> Column:
        x = F.col(column).cast("double")
        return x if digits is None else F.when(F.isnan(x), x).otherwise(F.round(x, digits))

    rows = F.array(*[F.struct(F.lit(name).alias("metric"), shown(c, d).alias("value")) for name, c, d in REPORT])
    return figures(df, tau).select(F.explode(rows).alias("x")).select("x.*")


@dataclass(frozen=True)
class Fold:
    """Rows [0, val_start) train, [val_start, train_end) validate, [train_end, test_end) test."""

    window_id: int
    val_start: int
    train_end: int
    test_end: int


def walk_forward_folds(n: int, windows: int = 5, first: float = 0.40, test: float = 0.10, val: float = 0.15, least_train: int = 600, least_test: int = 120) -> list[Fold]:
    """Expanding windows: training ends at equal steps from `first` of the rows to where one test stretch is left."""
    size, start = int(test * n), int(first * n)
    out = []
    for i in range(windows):
        end = int(start + (n - size - start) * i / (windows - 1)) if windows > 1 else start
        stop = min(end + size, n)
        if end >= least_train and stop - end >= least_test:
            out.append(Fold(i + 1, int((1 - val) * end), end, stop))
    return out


def fold_rows(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """A row for each window that a bar is in, with window_id and role; a few bounds beside each row, no join of rows."""
    if not folds:
        return df.limit(0).withColumns({"window_id": F.lit(0), "role": F.lit("")})
    roles = [
        F.when(F.col("seq") < f.test_end, F.struct(F.lit(f.window_id).alias("window_id"), F.when(F.col("seq") < f.val_start, "train").when(F.col("seq") < f.train_end, "val").otherwise("test").alias("role")))
        for f in folds
    ]
    return df.withColumn("_w", F.explode(F.filter(F.array(*roles), lambda x: x.isNotNull()))).select(*df.columns, "_w.*")


MEANS = ("n_trades", "win_rate", "sharpe", "cum_return", "max_drawdown", "s1_accuracy", "meta_auc")


def with_mean_row(results: DataFrame) -> DataFrame:
    """Walk-forward results and a MEAN row of the seven measured columns."""
    text = results.withColumn("window_id", F.col("window_id").cast("string"))
    mean = results.agg(*[F.avg(c).alias(c) for c in MEANS]).withColumn("window_id", F.lit("MEAN"))
    return text.withColumn("n_trades", F.col("n_trades").cast("double")).unionByName(mean, allowMissingColumns=True)


def signal_table(df: DataFrame, tau: float, base_lot: float = 1.0, max_mult: float = 2.0) -> DataFrame:
    """ts, primary_signal, meta_confidence, final_signal, position_size for the sink; figures rounded half to even."""
    from .labels import class_name

    final = gate(F.col("pred"), F.col("meta_prob"), F.lit(tau))
    return df.select(
        "ts",
        class_name(F.col("pred")).alias("primary_signal"),
        F.bround("meta_prob", 4).alias("meta_confidence"),
        class_name(final).alias("final_signal"),
        F.bround(position_size(F.col("meta_prob"), final, tau, base_lot, max_mult).cast("double"), 4).alias("position_size"),
    )


def trade_table(df: DataFrame, tau: float = 0.66) -> DataFrame:
    """ts, primary_signal, meta_prob, ret, result of the trades that the plain filter takes; result is the signed return."""
    from .labels import class_name

    return df.where(taken(F.col("meta_prob"), tau)).select("ts", class_name(F.col("pred")).alias("primary_signal"), "meta_prob", "ret", pnl(F.col("pred"), F.col("ret")).alias("result"))
