"""Features on hand-made bars: edge rules, causality, chunks, recurrences."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions.adf import adf_pvalues, mackinnon_p
from tidebar.functions.frames import in_stretches, of_series, rows, with_blocks
from tidebar.functions.scan import Scan, ewm, scans, ta_ema
from tidebar.operators.features import ALL, FEATURES, VARIANTS, features, register, registry

START = dt.datetime(2024, 1, 1)


def bars(spark, closes, spread=1.0, volumes=None, series="s", opens=None, highs=None, lows=None, times=None):
    rows = []
    for i, c in enumerate(closes):
        o = opens[i] if opens else (closes[i - 1] if i and closes[i - 1] is not None else c)
        body = [x for x in (o, c) if x is not None]
        h = highs[i] if highs else max(body) + spread
        low = lows[i] if lows else min(body) - spread
        t = times[i] if times else START + dt.timedelta(minutes=3 * i)
        price = [None if x is None else float(x) for x in (o, h, low, c)]
        rows.append((series, i, t, *price, float(volumes[i] if volumes else 10 + i % 7)))
    return spark.createDataFrame(rows, "series_id string, seq long, ts timestamp, open double, high double, low double, close double, volume double")


def table(df, *names):
    return [tuple(r) for r in df.orderBy("seq").select(*names).collect()]


def walk(n, seed=0):
    return (100 + np.cumsum(np.random.default_rng(seed).normal(size=n))).tolist()


def test_registry_is_complete():
    assert len(ALL) == len(set(ALL)) == 104 and len(VARIANTS) == 7


def test_runs_and_flat_bar(spark):
    df = features(bars(spark, [1.0, 2.0, 3.0, 2.0, 3.0, 3.0], 0.0, opens=[1.0, 1, 2, 3, 2, 3]), ["consecutive_up", "consecutive_down", "close_position", "body_ratio"])
    got = table(df, "consecutive_up", "consecutive_down", "close_position", "body_ratio")
    assert [g[0] for g in got] == [0, 1, 2, 0, 1, 0] and [g[1] for g in got] == [0, 0, 0, 1, 0, 0]
    assert got[0][2:] == (None, None) and got[5][2:] == (None, None) and got[1][2:] == (1.0, 1.0)


def test_constant_prices(spark):
    df = features(bars(spark, [5.0] * 150, 0.0))
    last = df.orderBy(F.desc("seq")).first()
    assert last["rsi_14"] == 0 and last["cci_14"] == 0 and last["williams_r"] == 0 and last["stoch_k"] == 0 and last["roc_5"] == 0 and last["entropy_30"] == 0
    assert last["linear_reg_r2_20"] == 0 and last["di_plus"] == 0 and last["atr_14"] == 0
    for n in ("bar_return_zscore", "atr_ratio", "rolling_skew_30", "variance_ratio", "autocorr_1", "autocorr_10", "adf_pvalue_100", "volume_price_corr", "close_position", "dx_cross", "vortex_plus"):
        assert last[n] is None, n


def test_missing_close_is_carried_for_returns(spark):
    closes = walk(40)
    closes[20] = None
    got = table(features(bars(spark, closes), ["bar_return_zscore", "gap", "volume_price_corr"]), "bar_return_zscore", "gap", "volume_price_corr")
    assert got[19][0] is None and got[20][0] is not None and got[21][1] is None and got[39][2] is not None


def test_money_flow(spark):
    up = features(bars(spark, [float(i) for i in range(10, 40)]), ["mfi_14"])
    down = features(bars(spark, [float(i) for i in range(40, 10, -1)]), ["mfi_14"])
    assert table(up, "mfi_14")[-1] == (100.0,) and table(down, "mfi_14")[-1] == (0.0,)
    assert table(up, "mfi_14")[12] == (None,)


def test_swing_low_wins_and_looks_one_bar_ahead(spark):
    closes = [10.0] * 30
    highs, lows = [11.0] * 30, [9.0] * 30
    highs[20], lows[20] = 15.0, 5.0
    got = table(features(bars(spark, closes, highs=highs, lows=lows, opens=closes), ["swing_strength", "atr_14"]), "swing_strength")
    assert got[19] == (None,) and got[20][0] == pytest.approx(5 / ((13 * 2 + 10) / 14)) and got[29][0] is not None


def test_sessions(spark):
    hours = [0, 6, 7, 8, 11, 12, 15, 16, 20, 21, 23]
    times = [START + dt.timedelta(hours=h, minutes=30) for h in hours] + [dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 7), None]
    names = ["minutes_into_session", "minutes_to_close", "is_asian_session", "is_london_session", "is_newyork_session", "is_overlap_ln", "day_of_week_sin"]
    got = table(features(bars(spark, [1.0] * len(times), times=times), names), *names)
    assert [g[0] for g in got[:11]] == [30, 390, 450, 90, 270, 330, 510, 270, 510, None, None]
    assert [g[1] for g in got[:11]] == [450, 90, 30, 450, 270, 210, 30, 270, 30, None, None]
    assert [g[2] for g in got[:4]] == [1, 1, 1, 0] and [g[3] for g in got[1:4]] == [0, 1, 1] and got[5][5] == 1 and got[7][5] == 0
    assert got[11][6] == pytest.approx(0.0, abs=1e-12) and got[12][6] == pytest.approx(math.sin(2 * math.pi / 5))
    assert got[13][:6] == (None, None, 0, 0, 0, 0)


def test_values_come_from_the_past_only(spark):
    names = [n for n in ALL if n not in ("swing_strength", "adf_pvalue_100")]
    closes = walk(140)
    both = bars(spark, closes, series="a").unionByName(bars(spark, closes[:120] + [c + 5 for c in closes[120:]], series="b"))
    made = features(both, names).orderBy("seq").collect()
    a, b = ([tuple(r[n] for n in names) for r in made if r["series_id"] == s] for s in "ab")
    assert a[:120] == b[:120] and a[120] != b[120]


def test_series_do_not_mix(spark):
    names = ["rsi_14", "vwap_distance"]
    x, y = bars(spark, walk(80, 1), series="x"), bars(spark, walk(70, 2), series="y")
    both = features(x.unionByName(y), names)
    assert table(both.where("series_id = 'x'"), *names) == table(features(x, names), *names)


def test_recurrences_equal_loops(spark):
    n = 2500
    x = np.random.default_rng(3).normal(10, 2, n)
    df = with_blocks(spark.createDataFrame([("s", i, float(v), float(x[:200].mean())) for i, v in enumerate(x)], "series_id string, seq long, x double, m double"))
    got = np.array(table(scans(df, ewm("a", "x", 9), ta_ema("b", "x", 200, "m"), Scan("c", 0.5, F.col("x"), 0)), "a", "b", "c"), dtype=float)
    a, b, c = x[0], x[:200].mean(), 0.0
    for i in range(n):
        a = a + 0.2 * (x[i] - a) if i else x[0]
        c = 0.5 * c + x[i]
        if i > 199:
            b = b + 2 / 201 * (x[i] - b)
        assert got[i, 0] == pytest.approx(a, rel=1e-12) and got[i, 2] == pytest.approx(c, rel=1e-12)
        assert np.isnan(got[i, 1]) if i < 199 else got[i, 1] == pytest.approx(b, rel=1e-12)


def test_chunks_restart_running_sums_behind_their_warm_up(spark):
    df = bars(spark, walk(300))
    names = ["vwap_distance", "log_return", "rolling_skew_60"]
    whole, parts = table(features(df, names), *names), table(features(df, names, chunk_rows=150, warm_up=80), *names)
    assert len(parts) == 300 and parts[:150] == whole[:150] and [p[1:] for p in parts] == [w[1:] for w in whole]
    alone = table(features(bars(spark, walk(300)).where("seq >= 70").withColumn("seq", F.col("seq") - 70), ["vwap_distance"]), "vwap_distance")
    assert [p[0] for p in parts[150:]] == pytest.approx([v[0] for v in alone[80:]])


def odd_series(spark, n, gap=(2600, 4300)):
    """A series with a long rise, a flat stretch, single missing closes and a long run of them, beside a short one."""
    closes = walk(n, 8)
    closes[500:2300] = [closes[499] + 0.01 * i for i in range(1800)]  # a run over borders
    closes[2400:2560] = [50.0] * 160
    closes[2040:2080:2] = [None] * 20
    closes[gap[0] : gap[1]] = [None] * (gap[1] - gap[0])
    opens = walk(n, 10)
    made = bars(spark, closes, opens=opens, highs=[max(o, c or o) + 1 for o, c in zip(opens, closes)], lows=[min(o, c or o) - 1 for o, c in zip(opens, closes)])
    return made.unionByName(bars(spark, walk(300, 9), series="t")).repartition(3)


@pytest.mark.parametrize("family", [f for f in FEATURES if f != "session"])
def test_stretches_equal_one_pass(spark, family):
    """Series over several tasks: the values of every feature and variant are those of one pass."""
    df = odd_series(spark, 5000)
    names = [n for n in FEATURES[family] if n != "adf_pvalue_100"] + [n for n, f in registry.VARIANT_OF.items() if f == family]
    whole = {(r["series_id"], r["seq"]): r for r in features(df, names, task_rows=None, percentile_window=300).collect()}
    got = features(df, names, task_rows=2048, percentile_window=300).collect()
    assert len(got) == len(whole) == 5300
    for r in got:
        for name in names:
            a, b = r[name], whole[r["series_id"], r["seq"]][name]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)), (name, r["seq"], a, b)


def test_dickey_fuller_in_stretches(spark):
    df = odd_series(spark, 5000).where("seq < 2700")
    whole, cut = (sorted(map(tuple, features(df, ["adf_pvalue_100"], task_rows=t).select("series_id", "seq", "adf_pvalue_100").collect())) for t in (None, 1024))
    assert [r[:2] for r in cut] == [r[:2] for r in whole]
    assert all((a[2] is None) == (b[2] is None) and (a[2] is None or a[2] == pytest.approx(b[2], abs=1e-9)) for a, b in zip(cut, whole))


def test_features_of_a_row_alone_shuffle_nothing(spark):
    df = bars(spark, walk(50)).repartition(2)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert plan(features(df, FEATURES["session"])).count("Exchange") == plan(df).count("Exchange")
    assert "Join" not in plan(features(df, ["rsi_14", "adx_14", "atr_14", "log_return"]))


@pytest.mark.parametrize(("back", "ahead", "rows"), [(0, 0, 8), (3, 0, 8), (0, 13, 8), (20, 20, 8)])
def test_stretches_have_their_surroundings(spark, back, ahead, rows):
    df = spark.createDataFrame([("s", i, i * i) for i in range(50)], "series_id string, seq long, x long")
    cut = in_stretches(df, rows, back, ahead)
    got = {}
    for r in cut.collect():
        got.setdefault(r["series_id"]["stretch"], []).append((r["seq"], r["_own"]))
    for k in range(7):
        inside = range(rows * k, min(rows * k + rows, 50))
        around = range(max(rows * k - back, 0), min(rows * k + rows + ahead, 50))
        assert sorted(got[k]) == [(i, i in inside) for i in around]
    assert sorted(map(tuple, of_series(cut).collect())) == sorted(map(tuple, df.collect()))


def test_a_feature_of_ones_own(spark):
    register("half_rsi", "momentum", lambda: F.col("rsi_14") / 2)
    register("far_mean", "momentum", lambda: F.avg("rsi_14").over(rows(3000)), reach=3000)
    try:
        long = bars(spark, walk(5000))
        whole, cut = (table(features(long, ["far_mean"], task_rows=t), "far_mean") for t in (None, 1024))
        assert cut == [pytest.approx(x) for x in whole]
        got = table(features(bars(spark, walk(40)), ["half_rsi", "rsi_14"]), "half_rsi", "rsi_14")
        assert got[30][0] == pytest.approx(got[30][1] / 2)
    finally:
        registry.CUSTOM.clear()
    with pytest.raises(ValueError):
        register("rsi_14", "momentum", lambda: F.lit(1))


def test_a_feature_that_fails_leaves_the_others(spark):
    register("broken", "momentum", lambda: F.col("no_such_column"))
    try:
        df = bars(spark, walk(40))
        got = table(features(df, ["broken", "rsi_14"], on_error="null"), "broken", "rsi_14")
        assert got[30][0] is None and got[30][1] is not None
        with pytest.raises(Exception, match="no_such_column"):
            features(df, ["broken"]).collect()
    finally:
        registry.CUSTOM.clear()


def test_dickey_fuller(spark):
    rng = np.random.default_rng(0)
    still, drifting = rng.normal(size=(50, 100)), rng.normal(size=(50, 100)).cumsum(1)
    assert np.median(adf_pvalues(still)) < 0.01 and np.median(adf_pvalues(drifting)) > 0.2
    assert mackinnon_p(np.array([-2.86]))[0] == pytest.approx(0.05, abs=0.002) and np.isnan(adf_pvalues(np.ones((1, 100)))[0])


def test_pruned_features_need_no_python(spark):
    plan = features(bars(spark, walk(30)), ["log_return", "rsi_14"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "regr_slope" not in plan
