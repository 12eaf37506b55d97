"""Labels, preparation, evaluation and the two-stage run."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import evaluate as E
from tidebar.operators import labels as L
from tidebar.operators import prepare as P
from tidebar.operators.features import features
from tidebar.operators.leafwise import Growth
from tidebar.operators.sequence_training import Training
from tidebar.plans.pipeline import Config, Trained, extract_timeframes, read_features, run_inference, run_train, run_walk_forward, training_history
from tidebar.plans.signal_queries import QUERIES

from .test_features import bars, table, walk


def test_triple_barrier(spark):
    closes = [10.0, 10.5, 12.0, 11.0, 9.0, 9.0] + [9.0] * 24
    df = bars(spark, closes).withColumn("atr_14", F.when(F.col("seq") == 4, 0.0).otherwise(1.0))
    got = [r[0] for r in table(L.triple_barrier(df), "label_primary")]
    assert got[:6] == [1, 1, -1, -1, 0, 0] and set(got[-13:]) == {0}
    with pytest.raises(ValueError):
        L.triple_barrier(bars(spark, closes))


def test_fixed_horizon_and_classes(spark):
    got = [r[0] for r in table(L.fixed_horizon(bars(spark, [1.0, 1, 1, 2, 1.0001, 0.5, 2.0, 2.0])), "label_primary")]
    assert got == [1, 0, -1, 0, 1, 0, 0, 0]
    df = spark.createDataFrame([(-1,), (0,), (1,), (7,), (None,)], "l int").select(L.class_of(F.col("l")).alias("c"))
    assert [r[0] for r in df.collect()] == [0, 1, 2, 1, 1]


def test_clean_drops_flat_bars_and_numbers_anew(spark):
    closes = walk(60)
    highs, lows = [c + 2 for c in closes], [c - 2 for c in closes]
    highs[40] = lows[40] = closes[40]
    table_ = features(bars(spark, closes, highs=highs, lows=lows), [*P.CORE, "vol_percentile", "rsi_21"])
    df, names = P.clean(table_)
    assert "vol_percentile" not in names and df.count() == 60 - 14 - 1
    assert [r[0] for r in table(df, "seq")] == list(range(45)) and df.where("rsi_21 is null").count() == 0 and table(df, "rsi_21")[0] == (0.0,)


def test_scaler_of_flat_feature(spark):
    df = spark.createDataFrame([("s", i, 1.0, float(i)) for i in range(5)], "series_id string, seq long, a double, b double")
    params = P.fit_scaler(df, ["a", "b"])
    assert sorted(map(tuple, params.collect())) == [("a", 1.0, 1.0), ("b", 2.0, 2.0)]
    odd = df.withColumn("b", F.when(F.col("seq") == 0, float("inf")).otherwise(F.col("b")))
    assert [r[0] for r in table(P.scale(odd, params, ["a", "b"]), "b")] == [0.0, -0.5, 0.0, 0.5, 1.0]


@pytest.mark.parametrize("step", [1, 7])
def test_sequences_hold_every_window(spark, step):
    df = spark.createDataFrame([("s", i, float(i), float(i * i), i % 3) for i in range(80)], "series_id string, seq long, a double, b double, y int")
    got = sorted(P.sequences(df, ["a", "b"], 60, step, "y").collect(), key=lambda r: r["seq"])
    want = [("s", e, [[float(i), float(i * i)] for i in range(e - 59, e + 1)], e % 3) for e in range(59, 80, step)]
    assert [tuple(r) for r in got] == want


def test_a_query_windows_every_bar_and_feature(spark):
    made = QUERIES["sequences_every_bar"](spark, "/root/testdata/sf0.001")
    got = {r["seq"]: r for r in made.collect()}
    assert sorted(got) == list(range(59, max(got) + 1))
    widths = {len(bar) for r in got.values() for bar in r["x"]}
    assert len(widths) == 1 and widths.pop() > 90 and {len(r["x"]) for r in got.values()} == {60}
    for e in range(60, max(got) + 1):
        assert got[e]["x"][:-1] == got[e - 1]["x"][1:] and got[e]["y"] == e % 3


def test_missing_returns_are_not_skipped(spark):
    df = spark.createDataFrame([(0, 2, 1.0, 1.0), (1, 0, 1.0, 1.0), (2, 2, 1.0, float("nan"))], "seq long, signal int, size double, ret double")
    r = E.trade_metrics(df).first()
    assert r["n_trades"] == 3 and r["win_rate"] == pytest.approx(1 / 3) and math.isnan(r["sharpe"]) and math.isnan(r["cum_return"])
    none = E.trade_metrics(df.withColumn("signal", F.lit(1))).first()
    assert none["n_trades"] == 0 and none["sharpe"] is None and none["win_rate"] is None


def test_sweep(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(p), int(rng.integers(2)), int(rng.integers(3)), float(rng.normal())) for i, p in enumerate(np.round(rng.uniform(0, 0.8, 300), 2))]
    df = spark.createDataFrame(rows, "seq long, meta_prob double, y_meta int, pred int, ret double")
    got = sorted(E.sweep(df).collect(), key=lambda r: r["tau"])
    p, y, pred, ret = (np.array(c) for c in list(zip(*rows))[1:])
    for i, r in enumerate(got):
        at = p >= 0.40 + i * 0.01
        assert r["n_trades"] == at.sum()
        if at.sum() < 10:
            assert math.isnan(r["sharpe"]) and math.isnan(r["precision"])
            continue
        g = (pred[at] - 1) * ret[at]
        assert r["precision"] == pytest.approx(y[at].mean(), abs=1e-4) and r["recall"] == pytest.approx(y[at].sum() / y.sum(), abs=1e-4)
        assert r["sharpe"] == pytest.approx(g.mean() / (g.std() + 1e-9) * math.sqrt(362880), abs=1e-3)
    best = max((r for r in got if not math.isnan(r["sharpe"])), key=lambda r: (r["sharpe"], -r["tau"]))
    assert E.best_tau(E.sweep(df)) == best["tau"]
    assert E.best_tau(E.sweep(df.limit(3))) == 0.55


def test_gate_and_filter_differ_at_the_threshold(spark):
    df = spark.createDataFrame([(2, 0.55), (1, 0.9), (0, 0.54)], "pred int, p double")
    got = df.select(E.gate(F.col("pred"), F.col("p"), 0.55).alias("g"), E.taken(F.col("p"), 0.55).alias("t")).collect()
    assert [tuple(r) for r in got] == [(2, False), (1, True), (1, False)]


def test_trades_of_the_plain_filter(spark):
    df = spark.createDataFrame([(1, 2, 0.9, 0.5), (2, 0, 0.7, 0.25), (3, 2, 0.66, 1.0), (4, 1, 0.8, 1.0)], "ts int, pred int, meta_prob double, ret double")
    got = E.trade_table(df).orderBy("ts").collect()
    assert [(r["ts"], r["result"]) for r in got] == [(1, 0.5), (2, -0.25), (4, 0.0)] and len({r["primary_signal"] for r in got}) == 3


def test_a_table_for_each_time_frame(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("utc,open,high,low,close,volume\n" + "".join(f"2024-01-01 00:{i:02d}:00,{i + 1},{i + 2},{i},{i + 1.5},3\n" for i in range(20)))
    extract_timeframes(spark, str(tmp_path), str(tmp_path / "out"), {"1min": "a.csv", "5min": "b.csv"}, ["log_return"])
    for name in ("1min", "5min"):
        assert spark.read.parquet(str(tmp_path / "out" / name)).where("log_return is not null").count() == 19


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0), (0.7, 0)], "p double, y int")
    assert E.roc_auc(df, "p", "y").first()[0] == pytest.approx((0.5 + 1 + 0 + 3) / 6)
    assert E.roc_auc(df.where("y = 1"), "p", "y").first()[0] is None


def test_walk_forward_bounds():
    folds = E.walk_forward_folds(20_000)
    assert [f.train_end for f in folds] == [8000, 10500, 13000, 15500, 18000] and folds[-1].test_end == 20_000 and folds[0].val_start == 6800
    assert E.walk_forward_folds(1000) == []


QUICK = Config(folds=2, sequence_length=12, width=8, heads=2, layers=1, inner=8, dropout=0.0, training=Training(epochs=2, rate=0.01), growth=Growth(trees=3, leaves=4, rate=0.3, least_rows=5, bins=16))


@pytest.fixture(scope="module")
def feature_table(spark, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("features") / "table")
    features(bars(spark, walk(420, 5), volumes=[10.0] * 420), [*P.CORE, "macd_histogram"], task_rows=None).write.parquet(path)
    return path


def test_train_and_infer(spark, tmp_path, feature_table):
    """The whole run on a few features, with a small network and few trees; a model that was saved and loaded gives the same signals."""
    made = read_features(spark, feature_table, [*P.CORE, "macd_histogram"])
    trained, report = run_train(made, QUICK, f"file://{tmp_path}/epochs")
    assert [r["metric"] for r in report.collect()] == [n for n, _, _ in E.REPORT]
    history = training_history(trained).orderBy("epoch").collect()
    assert [h["epoch"] for h in history] == [1, 2] and history[1]["train_loss"] < history[0]["train_loss"]
    assert trained.sequence_length == 12 and set(trained.scaler) == set(trained.names) and 0.4 <= trained.tau <= 0.85
    trained.save(spark, f"file://{tmp_path}/model")
    again = Trained.load(spark, f"file://{tmp_path}/model")
    assert (again.names, again.tau, again.scaler) == (trained.names, trained.tau, trained.scaler)
    first, second = (sorted(map(tuple, run_inference(made, t, QUICK).collect())) for t in (trained, again))
    rows = made.where(" AND ".join(f"{n} IS NOT NULL" for n in P.CORE)).count()
    assert first == second and len(first) == rows - 11
    with pytest.raises(ValueError, match="macd_histogram"):
        run_inference(made.drop("macd_histogram"), trained, QUICK)


def test_walk_forward(spark, feature_table):
    results = run_walk_forward(spark.read.parquet(feature_table), replace(QUICK, folds=1), windows=2, least_train=100, least_test=30).collect()
    assert [r["window_id"] for r in results] == ["1", "2", "MEAN"]
    assert results[2]["sharpe"] == pytest.approx((results[0]["sharpe"] + results[1]["sharpe"]) / 2) and results[0]["train_size"] < results[1]["train_size"]
    with pytest.raises(ValueError):
        run_walk_forward(spark.read.parquet(feature_table), QUICK)


def test_feature_tables_are_checked(spark, feature_table, tmp_path):
    names = [*P.CORE, "macd_histogram"]
    table_ = spark.read.parquet(feature_table)
    table_.withColumn("extra", F.lit(1)).write.option("header", True).csv(f"file://{tmp_path}/csv")
    got = read_features(spark, f"file://{tmp_path}/csv", names, "csv")
    assert got.columns == ["series_id", "seq", "ts", "open", "high", "low", "close", "volume", *names]
    key = lambda r: tuple(None if v is None else v for v in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, table_.select(got.columns).collect()))
    with pytest.raises(ValueError, match="rsi_99"):
        read_features(spark, feature_table, ["rsi_99"])
    table_.withColumn("rsi_14", F.array("rsi_14")).write.parquet(f"file://{tmp_path}/odd")
    with pytest.raises(ValueError, match="rsi_14"):
        read_features(spark, f"file://{tmp_path}/odd", names)


def test_labels_returns_and_windows_in_stretches(spark):
    """Rows of a series over several tasks, windows longer than a stretch: the same as in one, and no task has a series."""
    df = bars(spark, walk(400, 4)).unionByName(bars(spark, walk(50, 5), series="t")).withColumns({"atr_14": F.lit(1.0), "y": F.lit(1)}).repartition(3)
    for make in (L.triple_barrier, L.fixed_horizon, E.next_return, lambda d, task_rows: P.sequences(d, ["open", "close"], 60, 3, "y", task_rows)):
        whole, cut = make(df, task_rows=1000), make(df, task_rows=16)
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, cut.collect()))
        plan = make(df, task_rows=16)._jdf.queryExecution().executedPlan().toString()
        assert "_at" in plan and "hashpartitioning(series_id" in plan
        assert plan.count("hashpartitioning") == 1


def test_rows_with_a_whole_window(spark):
    df = spark.createDataFrame([(s, 100 + 2 * i, i) for s in "ab" for i in range(25)], "series_id string, seq long, ts int")
    got = P.with_window(df, 20)
    assert sorted((r["series_id"], r["ts"]) for r in got.collect()) == [(s, i) for s in "ab" for i in range(19, 25)]
