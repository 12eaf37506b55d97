"""Bar tables: readers, adapters from event streams, and sinks.

A bar table has series_id, seq (0, 1, ... in each series), ts, open, high, low, close, volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OHLCV = ("open", "high", "low", "close", "volume")
TIME_NAMES = ("utc", "datetime", "timestamp")
#: Input files by time frame; a deployment sets its own.
TIMEFRAMES: dict[str, str] = {"1min": "bars_1min.csv", "3min": "bars_3min.csv", "5min": "bars_5min.csv"}


def number_rows(df: DataFrame, keys: list[str], order: list[Column], bucket: Column) -> DataFrame:
    """seq from 0 in the given order within keys, without sorting a whole series in one task.

    bucket must be monotone in the order (a day of the timestamp). Rows are numbered within buckets, and running
    totals of the bucket counts, a row for each bucket, are added.
    """
    df = df.withColumn("_bucket", bucket)
    by = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = df.withColumn("_in", F.row_number().over(by) - 1).alias("l")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_bucket")]
    joined = numbered.join(starts.alias("r"), on)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns if c != "_bucket"], (F.col("_start") + F.col("_in")).alias("seq"))


def sequence_bars(bars: DataFrame) -> DataFrame:
    """Order bars by time; undated ones come last. Ties go by the bar's own values."""
    order = [F.col("ts").asc_nulls_last(), *[F.col(c) for c in OHLCV]]
    return number_rows(bars, ["series_id"], order, F.to_date("ts")).select("series_id", "seq", "ts", *OHLCV)


def read_bars(spark: SparkSession, path: str, series: str = "all", fmt: str = "csv") -> DataFrame:
    """Bars from files with a header: a time column named utc, datetime or timestamp, and open ... volume, in any case.

    Times that don't parse are null and sort last. Without a time column bars are dated to the epoch and keep
    their file order. Missing price columns are an error.
    """
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    by_lower = {c.lower(): c for c in reversed(raw.columns)}
    missing = [c for c in OHLCV if c not in by_lower]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    time = next((by_lower[t] for t in TIME_NAMES if t in by_lower), None)
    values = [F.col(f"`{by_lower[c]}`").try_cast("double").alias(c) for c in OHLCV]
    if time is None:
        bars = raw.select(F.monotonically_increasing_id().alias("_place"), *values)
        bars = bars.withColumns({"series_id": F.lit(series), "ts": F.lit("1970-01-01 00:00:00").cast("timestamp")})
        return number_rows(bars, ["series_id"], [F.col("_place")], F.shiftright("_place", 33)).select("series_id", "seq", "ts", *OHLCV)
    ts = F.col(f"`{time}`").try_cast("timestamp")
    return sequence_bars(raw.select(F.lit(series).alias("series_id"), ts.alias("ts"), *values))


def has_columns(spark: SparkSession, path: str, *names: str, fmt: str = "csv") -> bool:
    """Whether a table has the columns, told from two of its rows."""
    reader = spark.read.option("header", True).format(fmt)
    return set(names) <= set(reader.load(path).limit(2).columns)


def _ohlcv(events: DataFrame, keys: list[str]) -> DataFrame:
    price, at = F.lit(100.0) + F.col("value"), F.struct("ts", "event_id")
    return events.groupBy(*keys).agg(
        F.min("ts").alias("ts"),
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum("value").alias("volume"),
    )


def _with_series(events: DataFrame, series: str | None) -> DataFrame:
    return events.withColumn("series_id", F.lit("all") if series is None else F.col(series))


def tick_bars(events: DataFrame, every: int = 5, series: str | None = None) -> DataFrame:
    """Bars of `every` consecutive events of a series (one series, or one for each value of a column)."""
    events = _with_series(events.select("event_id", "ts", "value", *([series] if series else [])), series)
    ordered = number_rows(events, ["series_id"], [F.col("ts"), F.col("event_id")], F.to_date("ts"))
    bars = _ohlcv(ordered.withColumn("bar", F.floor(F.col("seq") / every)), ["series_id", "bar"])
    return bars.select("series_id", F.col("bar").alias("seq"), "ts", *OHLCV)


def time_bars(events: DataFrame, length: str = "1 hour", series: str | None = None) -> DataFrame:
    """Bars of fixed stretches of time; empty stretches have none."""
    events = _with_series(events.select("event_id", "ts", "value", *([series] if series else [])), series)
    bars = _ohlcv(events.withColumn("w", F.window("ts", length)["start"]), ["series_id", "w"])
    return sequence_bars(bars.drop("ts").withColumnRenamed("w", "ts"))


def order_line_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars of unit prices by ship date, one series; volume is the quantity."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct(F.col("l_orderkey"), F.col("l_linenumber"), unit)
    bars = lineitem.groupBy(F.col("l_shipdate").cast("timestamp").alias("ts")).agg(
        F.min_by(unit, at).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.max_by(unit, at).alias("close"), F.sum("l_quantity").cast("double").alias("volume")
    )
    return sequence_bars(bars.withColumn("series_id", F.lit("all")))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", if_exists: str = "overwrite") -> None:
    """Sink for feature, history, sweep, report, signal and walk-forward tables; if_exists="ignore" skips what is there.

    Times in text formats have microseconds, so they read back as they were.
    """
    times = {name: "yyyy-MM-dd HH:mm:ss.SSSSSS" for name in ("timestampFormat", "timestampNTZFormat")}
    df.write.mode(if_exists).options(header=True, **times).format(fmt).save(path)
