"""What only larger tables showed."""

from __future__ import annotations

import functools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions.store import CODEC
from tidebar.operators import attention, prepare
from tidebar.operators import sequence_training as S
from tidebar.operators.features import FEATURES, features
from tidebar.plans import bar_queries, signal_queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def long_windows_filled(monkeypatch):
    """Ranks of volatility in a window that 200 bars fill, as a large table fills that of 362,880."""
    for module in (bar_queries, signal_queries):
        monkeypatch.setattr(module, "features", functools.partial(features, percentile_window=50))


def test_volatility_is_that_of_its_sql_when_the_long_window_is_filled(spark, long_windows_filled):
    got = bar_queries.queries()["features_volatility"](spark, SMALL)
    assert got.count() == 200 and got.where("vol_percentile is not null").count() == 0 and got.where("vol_zscore is not null").count() > 0


@pytest.mark.parametrize("query", ["cleaned", "scaled_all_features"])
def test_cleaned_columns_are_those_of_the_sql_when_the_long_window_is_filled(spark, long_windows_filled, query):
    got = signal_queries.QUERIES[query](spark, SMALL)
    left_out = {"vol_percentile", "empty"}
    assert not left_out & set(got.columns) and got.count() == 186 and {"rsi_7", "atr_14"} <= set(got.columns)


@pytest.mark.parametrize("layers", [1, 2])
def test_last_block_is_worked_out_for_the_token_alone(monkeypatch, layers):
    """The gradient is still that of the loss, with dropout as it was drawn."""
    shape, rng, places = attention.Shape(3, 5, 4, 2, layers, 6, 0.2), np.random.default_rng(1), []
    x, y, weights, bend = rng.normal(size=(7, 5, 3)), np.arange(7) % 3, np.array([1.0, 2.0, 0.5]), attention._Pass.bend
    monkeypatch.setattr(attention._Pass, "bend", lambda self, v: (places.append(v.shape[1:-1]), bend(self, v))[1])
    vector, grad = shape.start(2), np.zeros(shape.size)
    attention.loss_and_gradient(shape, vector, x, y, weights, np.random.default_rng(3), grad)
    assert places == [(6,)] * (layers - 1) + [(1,), ()]
    loss = lambda v: attention.loss_and_gradient(shape, v, x, y, weights, np.random.default_rng(3))[0]
    for i in rng.choice(shape.size, 60, replace=False):
        step = np.zeros(shape.size)
        step[i] = 1e-6
        assert abs((loss(vector + step) - loss(vector - step)) / 2e-6 - grad[i]) < 1e-5


def test_rows_of_a_series_are_counted_without_bringing_them_into_one_task(spark, monkeypatch):
    """As on tables that Spark doesn't take for small: sizes are no reason to broadcast here."""
    plans = []
    monkeypatch.setattr(S, "keep", lambda df: (plans.append(df), df)[1])
    df = spark.createDataFrame([("all", i, float(i), 0) for i in range(100)], "series_id string, seq long, a double, y int")
    was = {n: spark.conf.get(n, None) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for n in was:
            spark.conf.set(n, "-1")
        S.blocks(df, ["a"], length=10)
        for split in (prepare.time_split(df), prepare.time_folds(df), *plans):
            plan = split._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["part"]: r["count"] for r in prepare.time_split(df).groupBy("part").count().collect()} == {"train": 70, "val": 15, "test": 15}
    finally:
        for n, v in was.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_trend_goes_through_short_frames_for_each_row(spark):
    """Frames of n rows cost n steps a row: extremes over 26 and 52 rows are made of shorter ones, fits of one covariance."""
    rows = [("all", i, None, *((None,) * 4 if i == 70 else (c, c + 1 + i % 7, c - 1 - i % 5, c)), 1.0) for i, c in enumerate([100.0 + (i * i * 7 % 23 if i < 160 else 0) for i in range(240)])]
    bars = spark.createDataFrame(rows, "series_id string, seq long, ts timestamp, open double, high double, low double, close double, volume double")
    df = features(bars, FEATURES["trend"])
    plan = df._jdf.queryExecution().analyzed().toString()
    frames = [int(n) + 1 for n in re.findall(r"RowFrame, -(\d+), currentrow", plan)]
    assert frames and sum(n for n in frames if n > 14) <= 800 and "regr_" not in plan
    got = df.orderBy("seq").collect()
    high, low, close = ([r[k] for r in rows] for k in (4, 5, 6))
    for t, r in enumerate(got):
        if t < 25 or 70 in range(t - 25, t + 1):
            assert r["aroon_up"] is None and r["aroon_down"] is None
        else:
            up, down = (max(range(t - 25, t + 1), key=lambda i: (x[i], i)) for x in (high, [-v if v is not None else None for v in low]))
            assert (r["aroon_up"], r["aroon_down"]) == (100 * (25 - t + up) / 25, 100 * (25 - t + down) / 25)
        for n in (20, 50):
            whole = lambda k: t >= k - 1 and 70 not in range(t - k + 1, t + 1)  # noqa: B023, E731
            assert (r[f"linear_reg_slope_{n}"] is not None, r[f"linear_reg_r2_{n}"] is not None) == (whole(n), whole(2 * n - 1))
            if whole(n):
                assert abs(r[f"linear_reg_slope_{n}"] - np.polyfit(range(n), close[t - n + 1 : t + 1], 1)[0]) < 1e-9
            if whole(2 * n - 1):
                ends = [np.polyval(np.polyfit(range(n), close[k - n + 1 : k + 1], 1), n - 1) for k in range(t - n + 1, t + 1)]
                varied = len(set(close[t - n + 1 : t + 1])) > 1
                assert abs(r[f"linear_reg_r2_{n}"] - (np.corrcoef(close[t - n + 1 : t + 1], ends)[0, 1] ** 2 if varied else 0)) < 1e-9


def test_windows_as_parquet_take_little_more_than_their_bars(spark, tmp_path):
    """Sixty times the bars otherwise: Spark's own codec looks back 64 KB, less than three windows of 100 features."""
    n, width = 4000, 100
    rows = spark.range(n, numPartitions=1).withColumnRenamed("id", "seq").withColumn("series_id", F.lit("all"))
    df = rows.withColumns({f"f{i}": F.rand(i) for i in range(width)})
    was = spark.conf.get(CODEC) if CODEC in spark.conf.getAll else None
    try:
        spark.conf.unset(CODEC)
        prepare.sequences(df, [f"f{i}" for i in range(width)]).write.parquet(str(tmp_path / "x"))
        assert sum(p.stat().st_size for p in (tmp_path / "x").rglob("*.parquet")) < n * width * 4 * 60 / 8
        spark.conf.set(CODEC, "snappy")  # as the session says
        prepare.sequences(df, ["f0"])
        assert spark.conf.get(CODEC) == "snappy"
    finally:
        spark.conf.unset(CODEC) if was is None else spark.conf.set(CODEC, was)


def test_features_are_made_once_and_numbered_once_for_windows(spark):
    """The rank of volatility is joined to bars; windows and scaler read the cleaned rows, not all that led to them."""
    bars = spark.createDataFrame([("all", i, None, *(100.0 + i * i % 23 + d for d in (0, 2, -2, 1)), 1.0) for i in range(200)], "series_id string, seq long, ts timestamp, open double, high double, low double, close double, volume double")
    assert features(bars)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    ranked = features(bars, ["rsi_7", "entropy_30", "vol_percentile"], percentile_window=50, task_rows=1024)
    assert ranked.columns == [*bars.columns, "rsi_7", "entropy_30", "vol_percentile"]
    got = [r["vol_percentile"] for r in ranked.orderBy("seq").collect()]
    atr = [r["atr_14"] for r in features(bars, ["atr_14"]).orderBy("seq").collect()]
    for t in range(200):
        if t < 63:
            assert got[t] is None
        else:
            less, same = (sum(test(x, atr[t]) for x in atr[t - 49 : t + 1]) for test in (float.__lt__, float.__eq__))
            assert abs(got[t] - (less + (same + 1) / 2) / 50) < 1e-12
    plan = signal_queries.QUERIES["sequences_every_bar"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window ") == 1
